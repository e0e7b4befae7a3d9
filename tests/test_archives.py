"""Archives that are made here: renamed, flattened, skipped when done, tried again when damaged."""

import io
import tarfile

from lingloom.sources import archives


def pack(path, files):
    with tarfile.open(path, "w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("an/empty/folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def language(path, name, number=6):
    inside = f"home/someone/packed/{name}"
    files = {f"{inside}/audio/{split}/{k}.wav": bytes([k]) * (1000 * k) for k in range(number) for split in ("train", "dev")}
    pack(path / f"{name}.tar.gz", files | {f"{inside}/train.tsv": b"1\ta\n", f"./{inside}/dev.tsv": b""})


def test_members_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "HELD", 2500)
    language(tmp_path, "oci_fr")
    pack(tmp_path / "de_de.tar.gz", {"top.wav": b"x", "test/a.wav": b"yy"})
    (tmp_path / "notes.txt").write_text("none")
    got = {(r.folder, r.lang, r.split, r.filename): bytes(r.content) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert len(got) == 16
    assert got["oci_fr", "oc_fr", "dev", "5.wav"] == b"\x05" * 5000 and got["oci_fr", "oc_fr", "train", "train.tsv"] == b"1\ta\n"
    assert got["oci_fr", "oc_fr", "dev", "dev.tsv"] == b"" and got["oci_fr", "oc_fr", "train", "0.wav"] == b""
    assert got["de_de", "de_de", "top", "top.wav"] == b"x" and got["de_de", "de_de", "test", "a.wav"] == b"yy"


def test_ingest_skips_what_is_there_and_tries_damaged_archives_again(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    language(source, "sd_arab_in")
    language(source, "en_us", 40)
    whole = (source / "en_us.tar.gz").read_bytes()
    (source / "en_us.tar.gz").write_bytes(whole[: len(whole) // 2])
    (source / "fr_fr.tar.gz").write_bytes(b"no archive")
    got = {r.lang: (r.n, r.error is None) for r in archives.ingested(spark, str(source), out).collect()}
    assert got == {"sd_in": (14, True), "en_us": (None, False), "fr_fr": (None, False)}
    assert {r.lang for r in spark.read.parquet(out).select("lang").distinct().collect()} == {"sd_in"}
    (source / "en_us.tar.gz").write_bytes(whole)
    (source / "sd_arab_in.tar.gz").write_bytes(b"not read again")
    got = {r.lang: (r.n, r.error is None) for r in archives.ingested(spark, str(source), out).collect()}
    assert got == {"en_us": (82, True), "fr_fr": (None, False)}
    rows = spark.read.parquet(out)
    assert rows.count() == 96 and set(rows.columns) == {"lang", "split", "filename", "content", "error"}
    (source / "fr_fr.tar.gz").unlink()
    assert archives.ingested(spark, str(source), out).collect() == []
