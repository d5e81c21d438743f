"""One query for each operator of this folder, over whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    anchors, bilinear, blobs, curriculum, decontaminate, divergence, linewindows, multiindex, personal, perspectives, quality, separators,
    whitening,
)
from plumbline.session import prepare, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


@query("op6_line_windows", """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, t[i] AS line, len(t) AS n FROM (
    SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) d, range(1, len(t) + 1) r(i)),
windows AS (
  SELECT doc_id, pos, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
real AS (SELECT * FROM windows WHERE pos + 2 < n AND trim(a || b || c) <> ''),
later AS (SELECT doc_id, pos FROM (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM real) x WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(0, 3) r(k))
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
  md5(coalesce(string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '')) AS left_over
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left of its text."""
    done = linewindows.without_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("left_over"))


@query("op9_curriculum", """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
capped AS (
  SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS full_at,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT min_by(level, (full_at, rank)) FROM levels WHERE level <= full_at)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (greatest(0, least(floor(target + 0.5) - before, size))
   + greatest(0, least(floor(target + 0.5) - source_size - before, size)))::BIGINT AS taken FROM placed""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, in the order of training."""
    rows = curriculum.planned(table(spark, folder, "documents")).orderBy("position", "draw")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


@query("op10_anchor_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprints of all documents and the component each belongs to."""
    rows = anchors.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, F.lit("0")).alias("fingerprint"), "component_id")


@query("op1_bm25_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a test item, with the items and how far question and answer overlap."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_quality_network")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_log_bilinear")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of all documents."""
    return bilinear.scored(table(spark, folder, "documents"))


@query("op2_weak_supervision_pii")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: base counts and digest, and all spans."""
    return personal.summarised(table(spark, folder, "documents"))


@query("op3_inverted_multi_index")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 50."""
    return multiindex.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_perspective_rotation", """
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS number FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS participant FROM turns WHERE role <> 'system'),
shown AS (
  SELECT t.conv_id, participant, number // 64 AS piece, number, role = participant AS mine,
    CASE WHEN role = participant THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || regexp_replace(role, '[\\s|<>]', '_', 'g') || '|>' || chr(10) END AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS tail
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, participant, piece ORDER BY number) - length(tail) AS low FROM shown)
SELECT conv_id, participant, piece::INTEGER AS piece, count(*)::INTEGER AS n_turns, sum(mine::INTEGER)::INTEGER AS n_masked,
  md5(string_agg(head || tail, '' ORDER BY number)) AS digest,
  coalesce(string_agg(CASE WHEN mine THEN low::BIGINT || ':' || (low + length(tail))::BIGINT END, ',' ORDER BY number), '') AS masks
FROM placed GROUP BY conv_id, participant, piece""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the point of view of each participant: digests of the texts, and the masks."""
    rows = perspectives.perspectives(table(spark, folder, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return rows.select("conv_id", "participant", "piece", "n_turns", "n_masked", F.md5("text").alias("digest"), masks.alias("masks"))


@query("op5_separator_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted between separators in flat token files made from all documents."""
    return separators.token_counts(table(spark, folder, "documents"))


@query("op11_shifted_cholesky_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector in up to 32 whitened coordinates, with its deviation and the spectrum."""
    vectors = table(spark, folder, "embeddings")
    found = whitening.fit(vectors)
    return whitening.by_component(whitening.whitened(vectors, found), found)


_ANY_CASE = "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in word)
                     for word in ("password", "passwd", "secret", "token", "api_?key"))
#: The rules as RE2 reads them: it has no look-behind, and its case folding goes beyond ASCII.
_SECRETS_SQL = {"assign": ("(" + _ANY_CASE + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
                **{r.name: r.pattern for r in blobs.RULES[len(blobs.BASE):]}}
_LEAST_SQL = {"assign": "len(regexp_extract(span, '{0}', 2)) >= 12", "access": "len(span) >= 18", "hex": "len(span) >= 16"}


def _rule_sql(number: int, name: str) -> str:
    pattern = _SECRETS_SQL[name].replace("'", "''")
    return f"""SELECT row, {number} AS number, '{name}' AS kind, {number} < {len(blobs.BASE)} AS base, last - length(span) AS first, last FROM (
      SELECT row, span, sum(length(gap) + length(span)) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM (
        SELECT row, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(list_append(spans, '')) AS span FROM (
          SELECT row, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS spans FROM docs) a) b) c
    WHERE span <> '' AND {_LEAST_SQL.get(name, 'true').format(pattern)}"""


@query("op12_blob_ledger_secrets", f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_rule_sql(i, r.name) for i, r in enumerate(blobs.RULES))}),
listed AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in blobs.BASE)},
  string_agg(CASE WHEN base THEN concat_ws(':', kind, first::BIGINT, last::BIGINT) END, ',' ORDER BY first, number) AS base,
  string_agg(concat_ws(':', kind, first::BIGINT, last::BIGINT), ',' ORDER BY first, number) AS spans FROM found GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0)::BIGINT AS n_{r.name}" for r in blobs.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (row)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents, each a first version of its own path, through a ledger that starts empty."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    index, ledger = blobs.addressed(docs), scratch_path(spark, "ledger")
    blobs.scan(docs, index, ledger)
    rows = blobs.findings(index, blobs.read_ledger(spark, ledger))
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in blobs.BASE]))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return rows.select(F.col("path").alias("doc_id"), *[count(r.name).alias(f"n_{r.name}") for r in blobs.BASE],
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op13_length_bucketed_divergence", r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs) x),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
own AS (SELECT lang, source, term, c.n FROM counts c JOIN kept USING (lang, term)),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL),
every AS (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (t.total + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM totals a
  JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM every WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks) x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that mark each."""
    return divergence.audited(table(spark, folder, "documents"))
