"""The registered queries of the text operators: each applies its operator with production parameters
to the whole table and derives the columns of its contract from the operator's output."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, fill_in_middle, html_extraction, imatch, licences, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_files, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, unless their Python path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    import tempfile

    archive = os.path.join(tempfile.mkdtemp(prefix="isochrone-"), "isochrone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "isochrone")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__, run.__module__ = name, fn.__doc__, fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Words of a text, and the ledger of the quality rules, in DuckDB's SQL.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LEDGER_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {{source}} s),
g AS (SELECT row_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) AS g, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5),
r AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, g) AS c FROM g) q WHERE c > 1),
n AS (SELECT row_id, count(DISTINCT p + k) AS n FROM (SELECT row_id, p, unnest(range(0, 5)) AS k FROM r) q GROUP BY row_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN n USING (row_id))
SELECT *,
  (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
   + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END
   + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
FROM m"""
DOCUMENTS_SQL = "(SELECT doc_id, text FROM documents)"


@query("op5_quality_rules", f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 23 = 0 AS kept, failed
FROM ({LEDGER_SQL.format(source=DOCUMENTS_SQL)}) x
""")
def op5(spark, sf_dir):
    recorded = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return recorded.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.kept().alias("kept"), "failed")


@query("op2_line_dedup")
def op2(spark, sf_dir):
    """Per document: its lines that are not blank, how many of them go, and their numbers."""
    per = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return per.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


@query("op9_simhash")
def op9(spark, sf_dir):
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_source_mixing", rf"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
p AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS per_weight FROM w
      WINDOW before AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least((SELECT per_weight FROM p WHERE per_weight * weight < 2.0::DOUBLE * source_size
        ORDER BY source_size / weight, encode(source) NULLS LAST LIMIT 1) * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size)::DOUBLE AS target FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('20240:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source
""")
def op10(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _url_sql() -> str:
    """Rules, links and the rounds of propagation, far beyond convergence, as one query."""
    fits = lambda text: f"((host = '{text[: text.index('/')]}' OR ends_with(host, '.{text[: text.index('/')]}')) AND starts_with(path, '{text[text.index('/'):]}'))"
    longest = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in longest) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    d, threshold, tolerance = url_filter.DAMPING, url_filter.THRESHOLD, url_filter.TOLERANCE
    host, path = lower.format("regexp_extract({rest}, '^[^/?#]*', 0, 's')"), "regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1, 's')"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {host.format(rest="rest")} AS host, {path.format(rest="rest")} AS path FROM u),
j AS MATERIALIZED (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS rule_verdict FROM p),
pl AS (SELECT host AS src, substr(link, 4) AS rest FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*[a-z]+(://[^"''\s>]+)', 1)) AS link FROM j) q),
l AS MATERIALIZED (SELECT src, {host.format(rest="rest")} AS host, {path.format(rest="rest")} AS path, count(*) AS n FROM pl GROUP BY ALL),
own AS (SELECT host, count(*) AS pages, count(*) FILTER (rule_verdict = 'allow') AS allowed, count(*) FILTER (rule_verdict = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host),
seen AS (SELECT host, {verdict} AS rule_verdict FROM (SELECT DISTINCT host, path FROM l) q WHERE host <> '' AND host NOT IN (SELECT host FROM own)),
hosts AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT host, 0, count(*) FILTER (rule_verdict = 'allow'), count(*) FILTER (rule_verdict = 'block') FROM seen GROUP BY host),
up AS (SELECT host AS src, unnest(list_transform(range(2, len(w) + 1), lambda i: array_to_string(w[i:], '.'))) AS dst FROM (SELECT host, string_split(host, '.') AS w FROM hosts) q),
a AS (SELECT src, arg_max(dst, length(dst)) AS dst FROM up WHERE dst IN (SELECT host FROM hosts) GROUP BY src),
b AS (SELECT src, host AS dst, n FROM l UNION ALL SELECT src, dst, 1 FROM a UNION ALL SELECT dst, src, 1 FROM a),
edges AS (SELECT src, dst, sum(n) AS n FROM b WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
flow AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, allowed::DOUBLE AS seed FROM hosts UNION ALL SELECT 'distrust', host, blocked::DOUBLE FROM hosts),
shares AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM flow),
steps AS (SELECT 0 AS i, kind, host, seed AS part FROM seeds UNION ALL
  SELECT steps.i + 1, steps.kind, dst, sum(share * part * {d}::DOUBLE) FROM steps JOIN shares ON shares.kind = steps.kind AND shares.src = steps.host WHERE steps.i < 250 AND part > 0 GROUP BY steps.i, steps.kind, dst),
final AS (SELECT host, sum(CASE kind WHEN 'trust' THEN part ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN part ELSE 0 END) AS distrust FROM steps GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN distrust - trust - {threshold}::DOUBLE * pages > {tolerance}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN (SELECT * FROM hosts JOIN final USING (host)) h ON j.host = h.host
"""


@query("op3_url_filter", _url_sql())
def op3(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def _licence_sql() -> str:
    """Phrases and templates as small tables, joined to the places of their words."""
    base = ", ".join(f"({b}, '{label}', {len(p.split())}, {i}, '{w}')" for b, (p, label) in enumerate(licences.PHRASES) for i, w in enumerate(p.split()))
    rows = []
    for t, (label, text, key) in enumerate(licences.TEMPLATES):
        rows += [f"({t}, '{label}', {i}, '{w}', {int(in_key)})" for i, w, in_key in licences.places(text, key)]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b(b, label, size, p, w) AS (VALUES {base}),
t(t, label, p, w, k) AS (VALUES {", ".join(rows)}),
h AS MATERIALIZED (SELECT row_id, pos, w FROM (SELECT row_id, unnest(w) AS w, unnest(range(0, len(w))) AS pos FROM d) q WHERE w IN (SELECT w FROM b UNION SELECT w FROM t)),
base AS (SELECT row_id, b.b, any_value(label) AS label, pos - p AS s FROM h JOIN b USING (w) GROUP BY row_id, b.b, pos - p HAVING count(*) = any_value(size)),
based AS (SELECT row_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY row_id),
sizes AS (SELECT t, count(*) AS n, sum(k) AS keys FROM t GROUP BY t),
found AS (SELECT row_id, t.t, any_value(label) AS label, count(*) AS hit, sum(k) AS keyed FROM h JOIN t USING (w) GROUP BY row_id, t.t, pos - p),
kept AS (SELECT row_id, label, hit / n AS share FROM found JOIN sizes USING (t) WHERE keyed = keys),
own AS (SELECT row_id, list(DISTINCT label) AS labels, max(share) AS share FROM kept GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)::DOUBLE AS score
FROM d LEFT JOIN based USING (row_id) LEFT JOIN own USING (row_id)
"""


@query("op4_licence_scan", _licence_sql())
def op4(spark, sf_dir):
    return licences.scan_documents(table(spark, sf_dir, "documents")).drop("matches")



@query("op6_imatch")
def op6(spark, sf_dir):
    rows = imatch.fingerprint_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", imatch.printed(F.col("hashes")).alias("fingerprint"), imatch.printed(F.col("edited_hashes")).alias("edited_fingerprint"),
        imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )



@query("op7_html_extraction")
def op7(spark, sf_dir):
    texts = html_extraction.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))



def _cluster_sql() -> str:
    """The rounds unrolled: distances of all vectors to all centroids, then floors of the means."""
    c = centroid_clusters
    rounds = []
    for i in range(c.ROUNDS + 1):
        rounds.append(f"""a{i} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS best FROM (
          SELECT n, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) q GROUP BY n)""")
        if i < c.ROUNDS:
            rounds.append(f"""m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (
          SELECT best.k AS k, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range({c.DIMENSIONS})) AS p FROM a{i}) q GROUP BY ALL) r GROUP BY k),
        c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    last = c.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({c.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {c.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('{c.SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept) q WHERE k < {c.CLUSTERS}),
{", ".join(rounds)}
SELECT vec_id, best.k::INTEGER AS "cluster", best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON best.k = c{last}.k
"""


@query("op11_centroid_clusters", _cluster_sql())
def op11(spark, sf_dir):
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_token_files")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_files(docs, TOKENIZER)
    return token_files.read_files(spark, manifest, docs.schema["doc_id"].dataType.simpleString())


@query("op13_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""")
def op13(spark, sf_dir):
    rows = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def register(queries: dict, oracles: dict) -> None:
    """Add the queries of this subpackage and the pipeline over its operators."""
    import corpus_pipeline

    queries.update(QUERIES)
    oracles.update(ORACLES)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
