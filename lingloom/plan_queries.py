"""Driver queries that run the corpus plans as a whole, on conversations in the role of a speech and a sentence corpus.

Every turn is a sentence in two languages: `aaa`, the pivot, and `bbb`, in small letters. Its spoken form is perturbed as
in `lingloom.queries`. A turn has one or two recordings; the first of some is silent, and some have no hypothesis.
Texts are ASCII-folded, as DuckDB measures distances in bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.functions import text
from lingloom.operators import nesting
from lingloom.plans import pipelines
from lingloom.queries import TURNS, query, sql_bleu, sql_fold, sql_normal, sql_strip, sql_words, turns
from lingloom.sources import sinks

REQUIRED = [(m, t) for m in ("whisper", "seamlessm4t") for t in ("transcription", "translation")]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, conv_id, turn, text, spoken."""
    t = turns(spark, sf_dir).select("conv_id", "turn", text.fold(F.col("text")).alias("text"), text.fold(F.col("spoken")).alias("spoken"))
    small = t.select(F.lit("bbb").alias("lang"), "conv_id", "turn", F.lower("text").alias("text"), F.lower("spoken").alias("spoken"))
    return t.select(F.lit("aaa").alias("lang"), "*").unionByName(small)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    return sentences(spark, sf_dir).select("lang", id_, F.col("text").alias("sentence"), F.col("conv_id").alias("url"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings, with the place j of each in its sentence."""
    r = sentences(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("turn").cast("int") % 2)))
    part = (F.col("conv_id") + F.col("turn") + F.col("j")) % 3
    return r.select(
        "lang",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("fleurs_id"),
        F.concat_ws("_", F.lit("r"), "conv_id", "turn", "j", F.concat("lang", F.lit(".wav"))).alias("filename"),
        F.col("spoken").alias("raw_transcription"),
        F.lower("spoken").alias("transcription"),
        F.length("spoken").alias("num_samples"),
        F.col("j").alias("speaker_id"),
        F.lit("F").alias("gender"),
        F.when(part == 0, "train").when(part == 1, "dev").otherwise("test").alias("split"),
        "conv_id",
        "turn",
        "j",
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).drop("conv_id", "turn", "j")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).select("filename", ((F.col("turn") % 5 == 4) & (F.col("j") == 0)).alias("is_silent"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, raw = speech(spark, sf_dir), F.col("raw_transcription")
    kept = ~((F.col("conv_id") % 6 == 5) & (F.col("turn") == 0))
    forms = {
        ("whisper", "transcription"): F.when(F.col("j") == 0, F.concat(raw, F.lit(" x"))).otherwise(F.concat(F.lit(" "), raw)),
        ("whisper", "translation"): F.concat(F.lit("so "), raw),
        ("seamlessm4t", "transcription"): F.replace(raw, F.lit("a"), F.lit("e")),
        ("seamlessm4t", "translation"): F.lower(raw),
    }
    of = lambda key: r.where(kept | F.lit(key[0] != "whisper")).select("lang", F.lit(key[0]).alias("model"), F.lit(key[1]).alias("task"), "filename", forms[key].alias("text"))
    return reduce(DataFrame.unionByName, map(of, forms))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.align(recordings(spark, sf_dir), reference(spark, sf_dir), activity(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, *errors: str) -> DataFrame:
    """Sentences scored by the error rates that the query reads."""
    return pipelines.score(aligned(spark, sf_dir), hypotheses(spark, sf_dir), REQUIRED, errors or ("cer", "wer"))


def listed(field: str, name: str = "recordings"):
    return F.array_join(F.transform(name, lambda x: x[field].cast("string")), ",")


# The same tables and plans in SQL.

TABLES = f"""{TURNS}, f AS (SELECT conv_id, turn, {sql_fold('text')} AS text, {sql_fold('spoken')} AS spoken FROM t),
s AS (SELECT 'aaa' AS lang, * FROM f UNION ALL SELECT 'bbb', conv_id, turn, lower(text), lower(spoken) FROM f),
ref AS (SELECT lang, conv_id * 1000 + turn AS id, text AS sentence, conv_id AS url FROM s),
sp AS (SELECT *, conv_id * 1000 + turn AS fleurs_id, 'r_' || conv_id || '_' || turn || '_' || j || '_' || lang || '.wav' AS filename, spoken AS raw,
  CASE (conv_id + turn + j) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, unnest(range(0, turn % 2 + 1)) AS j FROM s)),
sn AS (SELECT lang, fleurs_id, min(raw) AS raw, string_agg(filename, ',' ORDER BY filename, split) AS files, list(split ORDER BY filename, split) AS splits, count(*) AS n
  FROM sp WHERE NOT (turn % 5 = 4 AND j = 0) GROUP BY 1, 2)"""


def sql_links(p: str, left: str, right: str) -> str:
    """Tables that begin with p, the last {p}l(lang, a, b, match_type, distance); left gives lang, a; right lang, b, ord."""
    return f"""{p}w AS (SELECT DISTINCT lang, a FROM ({left})), {p}h AS (SELECT lang, b, min(ord) AS ord FROM ({right}) GROUP BY 1, 2),
{p}x AS (SELECT lang, a, a AS b, 'exact' AS match_type, 0 AS distance FROM {p}w WHERE EXISTS (SELECT 1 FROM {p}h WHERE {p}h.lang = {p}w.lang AND b = a)),
{p}r AS (SELECT lang, a, {sql_normal('a')} AS text FROM {p}w WHERE NOT EXISTS (SELECT 1 FROM {p}h WHERE {p}h.lang = {p}w.lang AND b = a)),
{p}n AS (SELECT lang, text, m.b AS b, m.ord AS ord FROM (SELECT lang, {sql_normal('b')} AS text, max({{'ord': ord, 'b': b}}) AS m FROM {p}h GROUP BY 1, 2)),
{p}c AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY distance, ord, near) AS k FROM (
  SELECT r.lang, r.text, n.text AS near, n.b, n.ord, levenshtein(r.text, n.text) AS distance FROM (SELECT DISTINCT lang, text FROM {p}r) r
  JOIN {p}n n ON r.lang = n.lang AND abs(length(r.text) - length(n.text)) <= 3) WHERE distance <= 3),
{p}l AS (SELECT * FROM {p}x UNION ALL SELECT r.lang, r.a, c.b, 'fuzzy', c.distance FROM {p}r r JOIN {p}c c ON r.lang = c.lang AND r.text = c.text WHERE k = 1)"""


ALIGNED = f"""{TABLES}, {sql_links('a', 'SELECT lang, raw AS a FROM sn', 'SELECT lang, sentence AS b, id AS ord FROM ref')},
al AS (SELECT ref.*, l.match_type, l.distance, sn.fleurs_id, sn.raw, sn.files, sn.splits, sn.n, count(*) OVER (PARTITION BY ref.lang, url) AS have
  FROM ref JOIN al_ l ON l.lang = ref.lang AND l.b = ref.sentence JOIN sn ON sn.lang = ref.lang AND sn.raw = l.a),
ag AS (SELECT al.*, have = need AS full_paragraph FROM al JOIN (SELECT lang, url, count(*) AS need FROM ref GROUP BY 1, 2) USING (lang, url))""".replace("al AS (SELECT * FROM ax", "al_ AS (SELECT * FROM ax")


@query(f"WITH {ALIGNED} SELECT lang, id, fleurs_id, match_type, distance::bigint AS distance, md5(raw) AS raw_md5, files, full_paragraph FROM ag")
def q_align(spark, sf_dir):
    out = aligned(spark, sf_dir)
    return out.select("lang", "id", "fleurs_id", "match_type", F.col("distance").cast("long").alias("distance"), F.md5("raw_transcription").alias("raw_md5"), listed("filename").alias("files"), "full_paragraph")


@query(f"""WITH {ALIGNED}, b AS (SELECT lang, count(*) AS sentences, count(DISTINCT raw) AS texts FROM sn GROUP BY 1),
k AS (SELECT lang, count(DISTINCT CASE WHEN match_type = 'exact' THEN raw END) AS exact_matches, count(DISTINCT CASE WHEN match_type = 'fuzzy' THEN raw END) AS recovered FROM ag GROUP BY 1),
p AS (SELECT lang, count(*) AS total_paragraphs, count(*) FILTER (whole) AS retained_paragraphs, count(*) FILTER (NOT whole) AS missing_paragraphs
  FROM (SELECT lang, url, bool_and(full_paragraph) AS whole FROM ag GROUP BY 1, 2) GROUP BY 1)
SELECT lang, sentences, exact_matches, texts - exact_matches AS difference, recovered, texts - exact_matches - recovered AS still_missing, total_paragraphs, retained_paragraphs, missing_paragraphs
FROM b JOIN k USING (lang) JOIN p USING (lang)""")
def q_align_statistics(spark, sf_dir):
    _, found = pipelines.align_report(recordings(spark, sf_dir), reference(spark, sf_dir), activity(spark, sf_dir))
    return found


CER = lambda h: f"levenshtein({sql_strip('raw')}, {sql_strip(h)}) / nullif(length({sql_strip('raw')}), 0)::double"
SCORED = f"""{ALIGNED}, fl AS (SELECT ag.lang, ag.id, ag.url, ag.sentence, sp.raw, sp.filename, sp.split, sp.j FROM ag JOIN sp ON sp.lang = ag.lang AND sp.fleurs_id = ag.fleurs_id
  WHERE NOT (sp.turn % 5 = 4 AND sp.j = 0) AND NOT (sp.conv_id % 6 = 5 AND sp.turn = 0)),
fh AS (SELECT *, {CER("CASE WHEN j = 0 THEN raw || ' x' ELSE ' ' || raw END")} AS w, {CER("replace(raw, 'a', 'e')")} AS m FROM fl),
sg AS (SELECT lang, url, sentence, min(id) AS id, count(*) AS n, string_agg(filename, ',' ORDER BY filename, split) AS files, list(split ORDER BY filename, split) AS splits, avg(w) AS w, avg(m) AS m,
  arg_min('so ' || raw, {{'error': w, 'filename': filename}}) AS best FROM fh GROUP BY 1, 2, 3),
sc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lang, url) AS have_ FROM sg) JOIN (SELECT lang, url, count(*) AS need_ FROM ag GROUP BY 1, 2) USING (lang, url) WHERE have_ = need_)"""
RESOLVED = """CASE WHEN list_contains(splits, 'train') THEN 'train' WHEN len(list_filter(splits, lambda x: x <> 'dev')) = 0 THEN 'dev' WHEN len(list_filter(splits, lambda x: x <> 'test')) = 0 THEN 'test'
WHEN 2 * len(list_filter(splits, lambda x: x = 'dev')) >= len(splits) THEN 'dev' ELSE 'test' END"""
ROUTED = "CASE WHEN list_contains(splits, 'train') THEN 'train' WHEN len(list_filter(splits, lambda x: x <> 'dev')) = 0 THEN 'validation' WHEN len(list_filter(splits, lambda x: x <> 'test')) = 0 THEN 'test' END"


def mean_of(field: str):
    return F.round(F.aggregate(F.col("recordings")[field], F.lit(0.0), lambda a, x: a + x) / F.size("recordings"), 6)


@query(f"WITH {SCORED} SELECT lang, url, md5(sentence) AS sentence_md5, n, files, round(w, 6) AS whisper_cer, round(m, 6) AS seamlessm4t_cer FROM sc")
def q_score(spark, sf_dir):
    cer = [mean_of(f"{m}_asr_cer").alias(f"{m}_cer") for m in ("whisper", "seamlessm4t")]
    return scored(spark, sf_dir, "cer").select("lang", "url", F.md5("sentence").alias("sentence_md5"), F.size("recordings").cast("long").alias("n"), listed("filename").alias("files"), *cer)


MEASURES = ", ".join(f"round(avg({m}) FILTER (split = '{s}'), 6) AS {s}_{name}_asr_cer_mean, round(stddev_samp({m}) FILTER (split = '{s}'), 6) AS {s}_{name}_asr_cer_std" for s in ("train", "dev", "test") for m, name in (("w", "whisper"), ("m", "seamlessm4t")))


@query(f"WITH {SCORED}, x AS (SELECT *, {RESOLVED} AS split FROM sc) SELECT lang, {MEASURES} FROM x GROUP BY 1")
def q_asr_summary(spark, sf_dir):
    out = pipelines.asr_summary(scored(spark, sf_dir, "cer"), errors=("cer",))
    return out.select("lang", *(F.round(c, 6).alias(c) for c in out.columns if "_cer_" in c))


# Word errors: one word more at the end is one edit; else by a row of the table of distances at a time, as in q_wer.
CHANGED = "replace(raw, 'a', 'e')"
WORD_ERRORS = f"""{SCORED}, kw AS (SELECT raw, {sql_words('raw')} AS rw, {sql_words(CHANGED)} AS w FROM (SELECT DISTINCT raw FROM fl)),
dw AS (SELECT raw, 0 AS j, range(0, len(rw) + 1) AS row FROM kw UNION ALL
  SELECT raw, j + 1, list_transform(range(0, len(u)), lambda i: i + list_min(u[1:i + 1])) FROM (
    SELECT raw, j, list_transform(range(0, len(rw) + 1), lambda i: CASE WHEN i = 0 THEN j + 1 ELSE least(row[i + 1] + 1, row[i] + CASE WHEN rw[i] = w[j + 1] THEN 0 ELSE 1 END) END - i) AS u
    FROM dw JOIN kw USING (raw) WHERE j < len(w))),
ew AS (SELECT raw, 1 / nullif(len(rw), 0)::double AS more, row[len(rw) + 1] / nullif(len(rw), 0)::double AS changed FROM dw JOIN kw USING (raw) WHERE j = len(w)),
sw AS (SELECT lang, url, sentence, list(split ORDER BY filename, split) AS splits, avg(CASE WHEN j = 0 THEN more WHEN more IS NULL THEN NULL ELSE 0 END) AS w, avg(changed) AS m
  FROM fl JOIN ew USING (raw) GROUP BY 1, 2, 3),
xw AS (SELECT sw.* FROM sw SEMI JOIN sc ON sc.lang = sw.lang AND sc.url = sw.url AND sc.sentence = sw.sentence)"""
WORD_MEASURES = MEASURES.replace("_asr_cer_", "_asr_wer_")


@query(f"WITH RECURSIVE {WORD_ERRORS}, x AS (SELECT *, {RESOLVED} AS split FROM xw) SELECT lang, {WORD_MEASURES} FROM x GROUP BY 1")
def q_asr_summary_wer(spark, sf_dir):
    out = pipelines.asr_summary(scored(spark, sf_dir, "wer"), errors=("wer",))
    return out.select("lang", *(F.round(c, 6).alias(c) for c in out.columns if "_wer_" in c))


SPOKEN = f"{TURNS}, p AS (SELECT role AS lang, conv_id * 1000 + turn AS id, {sql_fold('text')} AS sentence, {sql_fold('spoken')} AS spoken FROM t)"


@query(f"""WITH {SPOKEN}, {sql_links('v', 'SELECT lang, spoken AS a FROM p', 'SELECT lang, sentence AS b, id AS ord FROM p')},
n AS (SELECT lang, count(DISTINCT id) AS full_, count(DISTINCT spoken) AS texts FROM p GROUP BY 1),
m AS (SELECT lang, count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'fuzzy') AS near FROM vl GROUP BY 1)
SELECT lang, full_, coalesce(exact, 0) AS exact, texts - coalesce(exact, 0) AS miss, coalesce(near, 0) AS near FROM n LEFT JOIN m USING (lang)""")
def q_id_vs_set(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("role").alias("lang"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.fold(F.col("text")).alias("sentence"), text.fold(F.col("spoken")).alias("raw_transcription"))
    spoken = t.select("lang", F.col("id").alias("fleurs_id"), "raw_transcription")
    found = pipelines.id_against_set(spoken, t.select("lang", "id", "sentence"), t.select(F.col("id").alias("idx"), "id"), k=3)
    return found.withColumnRenamed("full", "full_")


PAIRS = f"""{SCORED}, x AS (SELECT id, best, {RESOLVED} AS split FROM sc WHERE lang = 'bbb'), y AS (SELECT x.id, x.best AS spoken, sc.sentence AS text, split FROM x JOIN sc ON sc.id = x.id AND sc.lang = 'aaa'),
z AS (SELECT split AS role, id, spoken, text FROM y UNION ALL SELECT 'all', id, spoken, text FROM y)"""
BLEU = "round(100 * CASE WHEN any_value(hyp_len) >= any_value(ref_len) THEN 1 ELSE exp(1 - any_value(ref_len) / any_value(hyp_len)::double) END * exp(sum(ln(m / t::double)) / 4), 5)"


@query(sql_bleu(f"SELECT 'bbb' AS lang, role AS split, {BLEU} AS bleu FROM s_ JOIN l_ USING (role) GROUP BY role", PAIRS, "SELECT role, id, spoken, text FROM z"))
def q_bleu_report(spark, sf_dir):
    return pipelines.bleu_report(scored(spark, sf_dir, "cer"), "aaa", "whisper").select("lang", F.coalesce("split", F.lit("all")).alias("split"), F.round("bleu", 5).alias("bleu"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.concat("text", F.lit(" and more")))
    name = F.element_at(F.array(*map(F.lit, pipelines.TOPICS)), (F.col("turn") % 7 + 1).cast("int"))
    return sentences(spark, sf_dir).select("lang", changed.alias("text"), name.alias("category"), F.lit("validation").alias("split"))


NAMES = ", ".join(f"'{t}'" for t in pipelines.TOPICS)
TOPIC_LINKS = f"""{ALIGNED}, tp AS (SELECT lang, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, length(text) - 1) ELSE text || ' and more' END AS text, turn % 7 AS code FROM s),
{sql_links('q', 'SELECT lang, text AS a FROM tp', 'SELECT lang, sentence AS b, id AS ord FROM ag')},
tl AS (SELECT tp.lang, md5(tp.text) AS text_md5, ql.match_type, tp.code, ag.id, ag.splits, ag.n FROM tp JOIN ql ON ql.lang = tp.lang AND ql.a = tp.text JOIN ag ON ag.lang = tp.lang AND ag.sentence = ql.b)"""


def topic_links(spark, sf_dir, by_split):
    spoken = aligned(spark, sf_dir).select("lang", "sentence", "id", "recordings")
    out = pipelines.link_topics(spoken, topics(spark, sf_dir), by_split=by_split)
    return out.select("lang", F.md5("text").alias("text_md5"), "match_type", F.col("category_code").cast("long").alias("code"), "id", "split", F.size("recordings").cast("long").alias("n"))


@query(f"WITH {TOPIC_LINKS}, x AS (SELECT *, {ROUTED} AS split FROM tl) SELECT lang, text_md5, match_type, code, id, split, n FROM x WHERE split IS NOT NULL")
def q_topics_by_recordings(spark, sf_dir):
    return topic_links(spark, sf_dir, False)


@query(f"WITH {TOPIC_LINKS} SELECT lang, text_md5, match_type, code, id, 'validation' AS split, n FROM tl")
def q_topics_by_split(spark, sf_dir):
    return topic_links(spark, sf_dir, True)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions about each passage; every fourth passage has words of its own."""
    n = nesting.nest(sentences(spark, sf_dir), ["lang", "conv_id"], ["turn"], ["text"])
    whole = F.array_join(F.transform("items", lambda x: x["text"]), " ")
    passage = F.when(F.col("conv_id") % 4 == 3, F.concat(whole, F.repeat(F.lit(" other words"), 40))).otherwise(whole)
    return n.select("lang", F.col("conv_id").alias("link"), passage.alias("passage"), F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("question"))


PASSAGES = f"""{ALIGNED}, it AS (SELECT lang, conv_id AS link, string_agg(text, ' ' ORDER BY turn) || CASE WHEN conv_id % 4 = 3 THEN repeat(' other words', 40) ELSE '' END AS passage FROM s GROUP BY 1, 2),
sd AS (SELECT lang, url AS link, string_agg(id::varchar, ',' ORDER BY id, sentence) AS ids, string_agg(sentence, ' ' ORDER BY id, sentence) AS joined, count(*) AS n, string_agg(files, ';' ORDER BY id, sentence) AS files FROM ag WHERE full_paragraph GROUP BY 1, 2),
ps AS (SELECT it.lang, it.link, ids, n, files, {sql_normal('passage')} AS x, {sql_normal('joined')} AS y FROM it JOIN sd ON sd.lang = it.lang AND sd.link = it.link),
pd AS (SELECT *, levenshtein(x, y) / greatest(length(x), length(y))::double AS distance FROM ps)"""


@query(f"WITH {PASSAGES} SELECT lang, link, question, ids, array_to_string(range(0, n), ',') AS places, files FROM pd, (VALUES ('q1'), ('q2')) v(question) WHERE distance < 0.05")
def q_passage_link(spark, sf_dir):
    good, _ = pipelines.link_passages(items(spark, sf_dir), aligned(spark, sf_dir))
    files = F.array_join(F.transform("sentence_data", lambda s: F.array_join(s["recordings"]["filename"], ",")), ";")
    return good.select("lang", "link", "question", listed("id", "sentence_data").alias("ids"), listed("sentence_idx", "sentence_data").alias("places"), files.alias("files"))


@query(f"WITH {PASSAGES} SELECT lang, link, round(distance, 6) AS distance FROM pd WHERE NOT distance < 0.05")
def q_passages_aside(spark, sf_dir):
    _, bad = pipelines.link_passages(items(spark, sf_dir), aligned(spark, sf_dir), measure=True)
    return bad.select("lang", "link", F.round("distance", 6).alias("distance"))


MISSING = """mp AS (SELECT DISTINCT 'data/' || split || '/' || filename AS path FROM pd JOIN ag ON ag.lang = pd.lang AND ag.url = pd.link JOIN sp ON sp.lang = ag.lang AND sp.fleurs_id = ag.fleurs_id
  WHERE pd.distance < 0.05 AND NOT (sp.turn % 5 = 4 AND sp.j = 0) AND sp.fleurs_id % 11 = 0)"""


@query(f"WITH {PASSAGES}, {MISSING} SELECT path FROM mp")
def q_passage_media(spark, sf_dir):
    """Files of the linked passages that a listing of the disk lacks: those of every eleventh sentence."""
    good, _ = pipelines.link_passages(items(spark, sf_dir), aligned(spark, sf_dir), media="data")
    paths = good.select(F.explode("sentence_data").alias("s")).select(F.explode("s.audio").alias("a")).select("a.path")
    r = speech(spark, sf_dir).where("fleurs_id % 11 <> 0")
    return sinks.missing_files(paths, r.select(text.media_path(F.lit("data"), F.col("split"), F.col("filename")).alias("path")))
