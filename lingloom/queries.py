"""Driver queries for the library's operators, on the tables of TESTDATA.md in the roles of speech and text corpora.

conversations are sentences (conv_id the paragraph, turn the place), a perturbed copy of them what was spoken; lineitem rows
of an order are the recordings of a sentence, with l_returnflag R, A, N as train, dev, test; labels.toxic is a silence flag;
embeddings are waveforms. Distances are taken of ASCII-folded text, as DuckDB counts bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.functions import bleu, splits, text
from lingloom.operators import completeness, linking, nesting, reports, similarity
from lingloom.plans import pipelines
from lingloom.sources.readers import remaining, spread
from lingloom.sources.sinks import silence_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their spoken form; a table of few row groups is dealt over all cores, as distances are dear."""
    spoken = F.when(F.col("turn") % 3 == 0, F.concat(F.expr("substring(text, 1, length(text) - 2)"), F.lit("!"))).when(F.col("turn") % 3 == 1, F.replace("text", F.lit(" la "), F.lit(" le "))).otherwise(F.col("text"))
    return spread(table(spark, sf_dir, "conversations")).withColumn("spoken", spoken)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.when(F.col("l_returnflag") == "R", "train").when(F.col("l_returnflag") == "A", "dev").otherwise("test")
    return table(spark, sf_dir, "lineitem").withColumn("split", flags)


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
TURNS = "t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN substring(text, 1, length(text) - 2) || '!' WHEN turn % 3 = 1 THEN replace(text, ' la ', ' le ') ELSE text END AS spoken FROM conversations)"
RECORDINGS = "r AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'train' WHEN 'A' THEN 'dev' ELSE 'test' END AS split FROM lineitem)"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
PUNCT = r"[\p{P}$+<=>^`|~]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normal(x: str) -> str:
    return f"regexp_replace(regexp_replace({sql_strip(x)}, '{WS}+', ' ', 'g'), '{PUNCT}', '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def sql_fold(x: str) -> str:
    return f"regexp_replace({x}, '[^ -~]', '?', 'g')"


@query(f"SELECT doc_id, md5({sql_normal('text')}) AS normal_md5 FROM documents")
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("normal_md5"))


@query(f"WITH {TURNS} SELECT a.conv_id, a.turn AS turn_spoken, b.turn AS turn_read FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.spoken = b.text")
def q_exact_link(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conv_id", F.col("turn").alias("turn_spoken"), F.col("spoken").alias("text")).join(t.select("conv_id", F.col("turn").alias("turn_read"), "text"), ["conv_id", "text"]).drop("text")


@query(f"WITH {TURNS} SELECT conv_id, turn FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.text = t.spoken)")
def q_link_unmatched(spark, sf_dir):
    t = turns(spark, sf_dir)
    return linking.unmatched(t, t, [], "spoken", "text").select("conv_id", "turn")


@query(f"""WITH {TURNS}, s AS (SELECT DISTINCT spoken AS x FROM t), w AS (SELECT DISTINCT text AS x FROM t)
SELECT (SELECT count(*) FROM s) AS spoken, (SELECT count(*) FROM w) AS written, (SELECT count(*) FROM (SELECT x FROM s INTERSECT SELECT x FROM w)) AS both_, (SELECT count(*) FROM (SELECT x FROM s EXCEPT SELECT x FROM w)) AS only_spoken""")
def q_link_stats(spark, sf_dir):
    t = turns(spark, sf_dir)
    sides = t.select(F.col("spoken").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("w")).unionByName(t.select(F.col("text").alias("x"), F.lit(0).alias("s"), F.lit(1).alias("w")))
    one = sides.groupBy("x").agg(F.max("s").alias("s"), F.max("w").alias("w"))
    return one.agg(F.sum("s").alias("spoken"), F.sum("w").alias("written"), F.sum(F.col("s") * F.col("w")).alias("both_"), F.sum(F.col("s") * (1 - F.col("w"))).alias("only_spoken"))


@query("SELECT text FROM (SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE source = 'src0')")
def q_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("lang = 'en'").select("text").intersect(d.where("source = 'src0'").select("text"))


@query("SELECT text FROM (SELECT text FROM documents WHERE lang = 'en' EXCEPT SELECT text FROM documents WHERE source = 'src0')")
def q_except(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("lang = 'en'").select("text").subtract(d.where("source = 'src0'").select("text"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def q_semi_voiced(spark, sf_dir):
    activity = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("filename"), (F.col("toxic") == 1).alias("is_silent"))
    return linking.voiced(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "filename").select("filename", "source"), activity).withColumnRenamed("filename", "doc_id")


@query("SELECT quality, sum(toxic)::bigint AS silent, count(*) AS total FROM labels GROUP BY quality")
def q_silence_counts(spark, sf_dir):
    return silence_counts(table(spark, sf_dir, "labels").withColumn("is_silent", F.col("toxic") == 1), "quality")


@query(f"""WITH {TURNS}, a AS (SELECT DISTINCT {sql_fold('spoken')} AS x FROM t), b AS (SELECT {sql_fold('text')} AS y, min(conv_id * 1000 + turn) AS ord FROM t GROUP BY 1),
p AS (SELECT x, y, ord, levenshtein(x, y) AS distance FROM a JOIN b ON abs(length(x) - length(y)) <= 3)
SELECT md5(x) AS a, md5(y) AS b, distance FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance, ord, y) AS k FROM p WHERE distance <= 3) WHERE k = 1""")
def q_fuzzy_link(spark, sf_dir):
    t = turns(spark, sf_dir)
    left = t.select(text.fold(F.col("spoken")).alias("text"))
    right = t.select(text.fold(F.col("text")).alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return similarity.nearest(left, right, 3).select(F.md5("a").alias("a"), F.md5("b").alias("b"), F.col("distance").cast("long").alias("distance"))


@query("WITH m AS (SELECT DISTINCT p_type AS o, upper(p_type) AS n FROM part WHERE p_size % 2 = 0) SELECT p_partkey, coalesce(n, p_type) AS p_type FROM part LEFT JOIN m ON p_type = o")
def q_value_rewrite(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mapping = p.where("p_size % 2 = 0").select(F.col("p_type").alias("old"), F.upper("p_type").alias("new")).distinct()
    return linking.rewritten(p.select("p_partkey", "p_type"), "p_type", mapping)


COMPLETE = f"{TURNS}, l AS (SELECT * FROM t WHERE spoken = text), n AS (SELECT conv_id, count(*) AS need FROM t GROUP BY 1), h AS (SELECT conv_id, count(*) AS have FROM l GROUP BY 1)"


def flagged(spark, sf_dir):
    t = turns(spark, sf_dir)
    return completeness.with_completeness(t.where("spoken = text"), t, ["conv_id"])


@query(f"WITH {COMPLETE} SELECT conv_id, turn, have = need AS full_paragraph FROM l JOIN h USING (conv_id) JOIN n USING (conv_id)")
def q_paragraph_complete(spark, sf_dir):
    return flagged(spark, sf_dir).select("conv_id", "turn", "full_paragraph")


@query(f"WITH {COMPLETE} SELECT conv_id % 7 AS part, count(*) AS total_paragraphs, sum(CASE WHEN have = need THEN 1 ELSE 0 END)::bigint AS retained_paragraphs, sum(CASE WHEN have = need THEN 0 ELSE 1 END)::bigint AS missing_paragraphs FROM h JOIN n USING (conv_id) GROUP BY 1")
def q_stats_csv(spark, sf_dir):
    return completeness.paragraph_counts(flagged(spark, sf_dir).withColumn("part", F.col("conv_id") % 7), ["part"], "conv_id")


@query("SELECT l_orderkey, greatest(count(l_partkey), count(l_suppkey), count(l_tax)) AS rows FROM lineitem GROUP BY 1")
def q_widest_count(spark, sf_dir):
    return completeness.widest_count(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_tax"), "l_orderkey")


@query(f"""WITH {RECORDINGS} SELECT l_orderkey, string_agg(split, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS splits, string_agg(cast(l_partkey AS varchar), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS parts, count(*) AS n FROM r GROUP BY 1""")
def q_nest_recordings(spark, sf_dir):
    n = nesting.parallel_arrays(nesting.nest(recordings(spark, sf_dir), ["l_orderkey"], ORDER, ["split", "l_partkey"]), ["split", "l_partkey"])
    return n.select("l_orderkey", F.array_join("split", ",").alias("splits"), F.array_join(F.col("l_partkey").cast("array<string>"), ",").alias("parts"), F.size("split").cast("long").alias("n"))


@query(f"WITH {RECORDINGS} SELECT l_orderkey, l_partkey, split FROM r")
def q_unnest(spark, sf_dir):
    return nesting.unnest(nesting.nest(recordings(spark, sf_dir), ["l_orderkey"], ORDER, ["l_partkey", "split"]))


@query(f"WITH {RECORDINGS} SELECT l_orderkey, split, count(*) AS n, sum(l_partkey)::bigint AS parts FROM r GROUP BY 1, 2")
def q_unnest_arrays(spark, sf_dir):
    n = nesting.parallel_arrays(nesting.nest(recordings(spark, sf_dir), ["l_orderkey"], ORDER, ["l_partkey", "split"]), ["l_partkey", "split"])
    return nesting.unnest_arrays(n, ["l_partkey", "split"]).groupBy("l_orderkey", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query(f"WITH {RECORDINGS} SELECT l_orderkey, count(DISTINCT split) = 1 AS constant, CASE WHEN count(DISTINCT split) = 1 THEN min(split) END AS value FROM r GROUP BY 1")
def q_const_or_list(spark, sf_dir):
    n = recordings(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("split").alias("s"))
    one = nesting.is_constant(F.col("s"))
    return n.select("l_orderkey", one.alias("constant"), F.when(one, F.get("s", F.lit(0))).alias("value"))


def by_order(spark, sf_dir):
    return recordings(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("split").alias("s"))


@query(f"""WITH {RECORDINGS} SELECT l_orderkey, CASE WHEN bool_or(split = 'train') THEN 'train' WHEN bool_and(split = 'dev') THEN 'dev' WHEN bool_and(split = 'test') THEN 'test' WHEN sum(CASE WHEN split = 'dev' THEN 1 ELSE -1 END) >= 0 THEN 'dev' ELSE 'test' END AS split FROM r GROUP BY 1""")
def q_split_resolve(spark, sf_dir):
    return by_order(spark, sf_dir).select("l_orderkey", splits.resolve(F.col("s")).alias("split"))


@query(f"""WITH {RECORDINGS}, x AS (SELECT l_orderkey, CASE WHEN bool_or(split = 'train') THEN 'train' WHEN bool_and(split = 'dev') THEN 'validation' WHEN bool_and(split = 'test') THEN 'test' END AS split FROM r GROUP BY 1) SELECT * FROM x WHERE split IS NOT NULL""")
def q_split_route(spark, sf_dir):
    return by_order(spark, sf_dir).select("l_orderkey", splits.route(F.col("s")).alias("split")).where("split IS NOT NULL")


CER = f"round(levenshtein({sql_fold(sql_strip('text'))}, {sql_fold(sql_strip('spoken'))}) / nullif(length({sql_strip('text')}), 0)::double, 6)"


def rated(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("cer", F.round(text.char_error_rate(text.fold(text.strip(F.col("text"))), text.fold(text.strip(F.col("spoken")))), 6))


@query(f"WITH {TURNS} SELECT conv_id, turn, {CER} AS cer FROM t")
def q_cer(spark, sf_dir):
    return rated(spark, sf_dir).select("conv_id", "turn", "cer")


# Edits of words, a row of the table of distances at a time: row[i + 1] is the distance of the first i words.
WER = f"""WITH RECURSIVE {TURNS}, k AS (SELECT conv_id, turn, {sql_words('text')} AS r, {sql_words('spoken')} AS h FROM t),
d AS (SELECT conv_id, turn, 0 AS j, range(0, len(r) + 1) AS row FROM k UNION ALL
  SELECT conv_id, turn, j + 1, list_transform(range(0, len(u)), lambda i: i + list_min(u[1:i + 1])) FROM (
    SELECT conv_id, turn, j, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN j + 1 ELSE least(row[i + 1] + 1, row[i] + CASE WHEN r[i] = h[j + 1] THEN 0 ELSE 1 END) END - i) AS u
    FROM d JOIN k USING (conv_id, turn) WHERE j < len(h)))
SELECT conv_id, turn, round(row[len(r) + 1] / nullif(len(r), 0)::double, 6) AS wer FROM d JOIN k USING (conv_id, turn) WHERE j = len(h)"""


@query(WER)
def q_wer(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(text.word_error_rate(F.col("text"), F.col("spoken")), 6).alias("wer"))


@query(f"WITH {TURNS} SELECT conv_id, count(*) AS n, string_agg(cast(turn AS varchar), ',' ORDER BY turn) AS turns, round(avg({CER}), 5) AS cer FROM t GROUP BY 1")
def q_score_regroup(spark, sf_dir):
    n = nesting.nest(rated(spark, sf_dir), ["conv_id"], ["turn"], ["turn", "cer"])
    return n.select("conv_id", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["turn"].cast("string")), ",").alias("turns"), F.round(reports.array_mean(F.transform("items", lambda x: x["cer"])), 5).alias("cer"))


@query(f"WITH {TURNS}, x AS (SELECT conv_id, turn, spoken, {CER} AS cer FROM t) SELECT conv_id, md5(spoken) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(cer, 'inf'::double), turn) AS k FROM x) WHERE k = 1")
def q_best_hypothesis(spark, sf_dir):
    n = nesting.nest(rated(spark, sf_dir), ["conv_id"], ["turn"], ["spoken", "cer"])
    return n.select("conv_id", F.md5(reports.best_hypothesis(F.transform("items", lambda x: x["spoken"]), F.transform("items", lambda x: x["cer"]))).alias("best"))


PIVOT = ", ".join(f"round(avg({m}) FILTER (split = '{s}'), 6) AS {s}_{m}_mean, round(stddev_samp({m}) FILTER (split = '{s}'), 6) AS {s}_{m}_std" for s in ("train", "dev", "test") for m in ("l_discount", "l_tax"))


@query(f"WITH {RECORDINGS} SELECT l_linestatus, {PIVOT} FROM r GROUP BY 1")
def q_asr_summary_pivot(spark, sf_dir):
    out = reports.pivot_summary(recordings(spark, sf_dir), "l_linestatus", "split", ["l_discount", "l_tax"])
    return out.select("l_linestatus", *(F.round(c, 6).alias(c) for c in out.columns if c != "l_linestatus"))


def sql_13a(x: str) -> str:
    for old, new in bleu.STEPS:
        x = f"replace({x}, '{old}', '{new}')" if "\n" not in old else f"replace({x}, {chr(39) + old.replace(chr(10), '') + chr(39)} || chr(10), '{new}')"
    x = f"' ' || {x} || ' '"
    for old, new in bleu.RULES:
        x = f"regexp_replace({x}, '{old}', '{new.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def sql_bleu(where: str, tables: str = TURNS, pairs: str = "SELECT role, conv_id * 1000 + turn AS id, spoken, text FROM t") -> str:
    """`where` may read s_(role, n, m, t), the matches and totals of each order, and l_(role, hyp_len, ref_len)."""
    grams = " UNION ALL ".join(
        f"SELECT role, id, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, greatest(len({s}) - {n - 1}, 0) + 1), lambda i: array_to_string({s}[i:i + {n - 1}], ' '))) AS g FROM k_" for n in bleu.ORDERS for s in ("h", "r")
    )
    return f"""WITH {tables}, k_ AS (SELECT role, id, {sql_13a('spoken')} AS h, {sql_13a('text')} AS r FROM ({pairs})),
g_ AS ({grams}), c_ AS (SELECT role, id, n, g, count(*) FILTER (side = 'h') AS ch, count(*) FILTER (side = 'r') AS cr FROM g_ GROUP BY ALL),
s_ AS (SELECT role, n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM c_ GROUP BY ALL), l_ AS (SELECT role, sum(len(h)) AS hyp_len, sum(len(r)) AS ref_len FROM k_ GROUP BY 1)
{where}"""


def pairs(spark, sf_dir):
    return turns(spark, sf_dir).select("role", "text", "spoken")


STATS = ", ".join(f"sum(m) FILTER (n = {n})::bigint AS match{n}, sum(t) FILTER (n = {n})::bigint AS total{n}" for n in bleu.ORDERS)


@query(sql_bleu(f"SELECT role, any_value(hyp_len)::bigint AS hyp_len, any_value(ref_len)::bigint AS ref_len, {STATS} FROM s_ JOIN l_ USING (role) GROUP BY role"))
def q_bleu_ngram(spark, sf_dir):
    return bleu.statistics(pairs(spark, sf_dir), "spoken", "text", ["role"])


@query(sql_bleu("SELECT role, round(100 * CASE WHEN any_value(hyp_len) >= any_value(ref_len) THEN 1 ELSE exp(1 - any_value(ref_len) / any_value(hyp_len)::double) END * exp(sum(ln(m / t::double)) / 4), 5) AS bleu FROM s_ JOIN l_ USING (role) GROUP BY role"))
def q_bleu(spark, sf_dir):
    return bleu.corpus_bleu(pairs(spark, sf_dir), "spoken", "text", ["role"]).select("role", F.round("bleu", 5).alias("bleu"))


@query(sql_bleu("""SELECT role, round(100 * CASE WHEN any_value(hyp_len) >= any_value(ref_len) THEN 1 ELSE exp(1 - any_value(ref_len) / any_value(hyp_len)::double) END * exp(sum(ln(CASE WHEN m = 0 THEN 1 / (pow(2, zeros) * t) ELSE m / t::double END)) / 4), 5) AS bleu
FROM (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY role ORDER BY n) AS zeros FROM s_) JOIN l_ USING (role) GROUP BY role HAVING sum(m) > 0""", pairs="SELECT conv_id::varchar AS role, turn AS id, array_to_string(list_reverse(string_split(spoken, ' ')), ' ') AS spoken, text FROM t"))
def q_bleu_smoothed(spark, sf_dir):
    """Words in reverse: many conversations share no longer n-gram, and smoothing stands in."""
    backward = F.array_join(F.reverse(F.split("spoken", " ")), " ")
    rows = turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("role"), backward.alias("spoken"), "text")
    return bleu.corpus_bleu(rows, "spoken", "text", ["role"]).where("bleu > 0").select("role", F.round("bleu", 5).alias("bleu"))


ROLES = ["user", "assistant", "system"]


@query("SELECT conv_id, turn, nullif(list_position(['user', 'assistant', 'system'], role), 0) - 1 AS code FROM conversations")
def q_class_encode(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.class_code(ROLES, F.col("role")).cast("int").alias("code"))


@query(f"WITH {RECORDINGS} SELECT l_orderkey, string_agg('data/' || split || '/' || l_partkey || '.wav', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS paths FROM r GROUP BY 1")
def q_audio_paths(spark, sf_dir):
    r = recordings(spark, sf_dir).withColumn("path", text.media_path(F.lit("data"), F.col("split"), F.concat(F.col("l_partkey"), F.lit(".wav"))))
    n = nesting.nest(r, ["l_orderkey"], ORDER, ["path"])
    return n.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["path"]), " ").alias("paths"))


@query(f"""WITH {TURNS}, w AS (SELECT DISTINCT {sql_fold('spoken')} AS a FROM t), h AS (SELECT {sql_fold('text')} AS b, min(conv_id * 1000 + turn) AS ord FROM t GROUP BY 1),
r AS (SELECT a, {sql_normal('a')} AS text FROM w WHERE a NOT IN (SELECT b FROM h)), n AS (SELECT text, m.b AS b, m.ord AS ord FROM (SELECT {sql_normal('b')} AS text, max({{'ord': ord, 'b': b}}) AS m FROM h GROUP BY 1)),
c AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, ord, near) AS k FROM (SELECT r.text, n.text AS near, n.b, n.ord, levenshtein(r.text, n.text) AS distance FROM (SELECT DISTINCT text FROM r) r JOIN n ON abs(length(r.text) - length(n.text)) <= 3) WHERE distance <= 3)
SELECT md5(a) AS a, md5(a) AS b, 'exact' AS match_type, 0::bigint AS distance FROM w WHERE a IN (SELECT b FROM h) UNION ALL SELECT md5(r.a), md5(c.b), 'fuzzy', c.distance FROM r JOIN c ON r.text = c.text WHERE k = 1""")
def q_topic_link(spark, sf_dir):
    t = turns(spark, sf_dir).select(text.fold(F.col("spoken")).alias("spoken"), text.fold(F.col("text")).alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return linking.links(t, t, "spoken", "text", [], "ord").select(F.md5("a").alias("a"), F.md5("b").alias("b"), "match_type", F.col("distance").cast("long").alias("distance"))


PASSAGE = f"p AS (SELECT conv_id, {sql_fold(sql_normal(chr(97)))} AS a, {sql_fold(sql_normal(chr(98)))} AS b FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS a, string_agg(spoken, ' ' ORDER BY turn) AS b FROM t GROUP BY 1))"


@query(f"WITH {TURNS}, {PASSAGE}, d AS (SELECT conv_id, levenshtein(a, b) / nullif(greatest(length(a), length(b)), 0)::double AS x FROM p) SELECT conv_id, round(x, 6) AS distance, x < 0.05 AS near FROM d")
def q_passage_distance(spark, sf_dir):
    n = nesting.nest(turns(spark, sf_dir), ["conv_id"], ["turn"], ["text", "spoken"])
    joined = lambda f: text.fold(text.normalise(F.array_join(F.transform("items", lambda x: x[f]), " ")))
    d = text.normalised_distance(joined("text"), joined("spoken"))
    return n.select("conv_id", F.round(d, 6).alias("distance"), (d < 0.05).alias("near"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sentence_idx FROM conversations")
def q_sentence_idx(spark, sf_dir):
    return nesting.numbered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("sentence_idx").cast("long").alias("sentence_idx"))


@query(f"""WITH {TURNS}, p AS (SELECT role AS lang, conv_id * 1000 + turn AS id, {sql_fold('text')} AS sentence, {sql_fold('spoken')} AS spoken FROM t),
r AS (SELECT DISTINCT lang, spoken, {sql_normal('spoken')} AS x FROM p WHERE spoken <> sentence), h AS (SELECT lang, sentence AS b, min(id) AS ord FROM p GROUP BY 1, 2),
e AS (SELECT r.lang, r.spoken, b AS nearest FROM r JOIN h ON r.lang = h.lang AND r.spoken = h.b),
n AS (SELECT lang, x, m.b AS b, m.ord AS ord FROM (SELECT lang, {sql_normal('b')} AS x, max({{'ord': ord, 'b': b}}) AS m FROM h GROUP BY 1, 2)),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY d, ord, y) AS k FROM (SELECT r.lang, r.x, n.x AS y, n.b, n.ord, levenshtein(r.x, n.x) AS d FROM (SELECT DISTINCT lang, x FROM r) r JOIN n ON r.lang = n.lang AND abs(length(r.x) - length(n.x)) <= 3) WHERE d <= 3),
l AS (SELECT * FROM e UNION ALL SELECT r.lang, r.spoken, c.b FROM r JOIN c ON c.lang = r.lang AND c.x = r.x WHERE k = 1 AND (r.lang, r.spoken) NOT IN (SELECT (lang, spoken) FROM e))
SELECT p.lang, count(*) AS full_, count(*) FILTER (p.spoken = sentence) AS exact, count(*) FILTER (p.spoken <> sentence) AS miss, count(*) FILTER (p.spoken <> sentence AND nearest = sentence) AS nearest_is_id
FROM p LEFT JOIN l ON l.lang = p.lang AND l.spoken = p.spoken GROUP BY 1""")
def q_id_vs_text(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.col("role").alias("lang"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.fold(F.col("text")).alias("text"), text.fold(F.col("spoken")).alias("spoken"))
    spoken = t.select("lang", F.col("id").alias("fleurs_id"), F.col("spoken").alias("raw_transcription"))
    found = pipelines.id_against_text(spoken, t.select("lang", "id", F.col("text").alias("sentence")), t.select(F.col("id").alias("idx"), "id"))
    return found.withColumnRenamed("full", "full_")


@query("SELECT c_custkey, coalesce(try_cast(regexp_replace(c_name, '[^0-9]', '', 'g') AS bigint), -1) AS number FROM customer")
def q_speaker_parse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.speaker_number(F.col("c_name")).alias("number"))


@query("""WITH x AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) AS rms FROM embeddings)
SELECT vec_id, round(rms, 6) AS rms, round(20 * log10(rms + 1e-9), 4) AS db, round(pow(10.0, (-25.0 - 20 * log10(rms + 1e-9)) / 20), 6) AS gain FROM x""")
def q_rms_gain(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").withColumn("rms", text.root_mean_square(F.col("embedding"))).withColumn("db", text.decibels(F.col("rms")))
    return x.select("vec_id", F.round("rms", 6).alias("rms"), F.round("db", 4).alias("db"), F.round(text.gain_to(-25.0, F.col("db")), 6).alias("gain"))


@query("WITH x AS (SELECT l_orderkey, sum(l_linenumber)::double AS speech, sum(round(l_quantity)) AS total FROM lineitem GROUP BY 1) SELECT l_orderkey, speech, speech / nullif(total, 0) < 1::double - 0.95::double AS silent FROM x")
def q_speech_ratio(spark, sf_dir):
    """Line numbers as seconds of speech: small whole numbers, so that the ratio meets its bound exactly for some orders."""
    second = F.struct(F.lit(0.0).alias("start"), F.col("l_linenumber").cast("double").alias("end"))
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(second).alias("s"), F.sum(F.round(F.col("l_quantity").cast("double"))).alias("total"))
    speech = text.interval_sum(F.col("s"))
    return n.select("l_orderkey", speech.alias("speech"), text.mostly_silent(speech, F.col("total")).alias("silent"))


@query("SELECT lang, count(*) AS n, sum(CASE WHEN n_chars / 100.0 < 30 THEN 1 ELSE 0 END)::bigint AS short FROM documents GROUP BY 1")
def q_duration_route(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("kind", text.duration_class(F.col("n_chars") / 100))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "short").alias("short"))


@query(f"WITH {RECORDINGS} SELECT l_orderkey, l_partkey, split FROM r WHERE split = 'dev' UNION ALL SELECT l_orderkey, l_partkey, split FROM r WHERE split = 'test'")
def q_union_splits(spark, sf_dir):
    r = recordings(spark, sf_dir).select("l_orderkey", "l_partkey", "split")
    return r.where("split = 'dev'").unionByName(r.where("split = 'test'"))


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def q_resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return remaining(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), done, ["o_orderkey"])
