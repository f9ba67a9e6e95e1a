"""The registered queries of the operators, and their DuckDB SQL.

Each query applies its operator to a whole table with production parameters and derives
the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import licences as LIC
from platewise.llm import hyper_lang as HL
from platewise.llm import mixing as MIX
from platewise.llm.ball_codes import compress
from platewise.llm.block_names import exact_groups
from platewise.llm.common import crc_mod, read
from platewise.llm.ego_join import link_vectors
from platewise.llm.html_main import extract_pages
from platewise.llm.kd_shards import assign_shards
from platewise.llm.line_dedup import dedup_lines
from platewise.llm.packing import pack
from platewise.llm.qr_whiten import whiten
from platewise.llm.setsketch import near_groups
from platewise.llm.suffix_lm import score_documents

BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL: dict[str, str] = {}


#: Component labels by repeated minimum over links; a fixed point of the whole table.
COMPONENTS_SQL = """
reach(x, y) AS (SELECT id, id FROM nodes UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
comp AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)"""


def op1_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_vectors(read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


SQL["op1_ego_join"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings),
nodes AS (SELECT id FROM v),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id
          WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
{COMPONENTS_SQL}
SELECT c.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.id) AS n_links, c.component_id,
       c.id = c.component_id AS kept FROM comp c"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL["op2_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> shared.keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL["op3_block_naming"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)"""


def op4_hyper_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    out = HL.identify(docs.select("doc_id", "text"), HL.learn_prototypes(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = MIX.mix_sources(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL["op5_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('{MIX.SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS top FROM s),
c AS (
  SELECT *, sum(weight) OVER (ORDER BY top / weight DESC, source ROWS UNBOUNDED PRECEDING) AS w_rest,
         coalesce(sum(top) OVER (ORDER BY top / weight, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
         1.5::DOUBLE * sum(source_size) OVER () AS goal FROM w),
f AS (SELECT *, top <= weight * ((goal - c_before) / w_rest) AS is_full FROM c),
r AS (
  SELECT *, coalesce(sum(top) FILTER (WHERE is_full) OVER (), 0) AS c_full,
         sum(weight) FILTER (WHERE NOT is_full) OVER () AS w_free FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN top ELSE (goal - c_full) * weight / w_free END AS target FROM r),
k AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) AS k,
         ('0x' || substr(md5('{MIX.SEED}:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target::VARCHAR::DECIMAL(38, 12), 6)::DOUBLE AS target,
       (least(2, greatest(0, floor(rate * k + u) - floor(rate * (k - 1) + u)))::BIGINT * size) AS taken FROM k"""


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


SQL["op6_setsketch"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [len(w)::VARCHAR || ' words ' || array_to_string(w, ' ')] ELSE [] END)) AS sh FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
nodes AS (SELECT id FROM w),
{COMPONENTS_SQL}
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.id = c.component_id AS kept
FROM comp c LEFT JOIN n ON n.id = c.id"""


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "source", "window")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op8_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)
    return out.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 4).alias("score"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = LIC.scan_licences(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_candidates", "licence",
                      F.round("dice", 6).alias("dice"), "line_no", "n_hits")


def _licence_sql() -> str:
    rows = []
    for name, text in sorted(LIC.TEMPLATES.items()):
        g = LIC.template_bigrams(text)
        lo, hi = LIC.size_bounds(len(g), 0.8)
        rows.append(f"('{name}', [{', '.join(repr(x) for x in g)}], {lo}, {hi})")
    return rf"""
WITH t(name, grams, lo, hi) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT rid, doc_id, len(string_split(text, chr(10))) AS n_lines,
         unnest(list_concat([text], string_split(text, chr(10)))) AS unit,
         unnest(range(-1, len(string_split(text, chr(10))))) AS no FROM d),
w AS (SELECT rid, doc_id, n_lines, no, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u),
b AS (
  SELECT rid, doc_id, n_lines, no,
         CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END AS b FROM w),
p AS (
  SELECT b.*, t.name, 2.0 * len(list_intersect(b.b, t.grams)) / (len(b.b) + len(t.grams)) AS dice
  FROM b LEFT JOIN t ON len(b.b) BETWEEN t.lo AND t.hi)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(name) AS n_candidates,
       first(name ORDER BY dice DESC, no, name) FILTER (WHERE dice >= 0.8) AS licence,
       round(max(dice::DOUBLE) FILTER (WHERE dice >= 0.8), 6) AS dice,
       first(no::INT ORDER BY dice DESC, no, name) FILTER (WHERE dice >= 0.8) AS line_no,
       count(DISTINCT no) FILTER (WHERE dice >= 0.8) AS n_hits
FROM p GROUP BY rid, doc_id"""


SQL["op9_licences"] = _licence_sql()

def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"))
    return (out.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened"))
            .select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col").alias("whitened"),
                    F.element_at("explained", F.col("pos") + 1).alias("explained"), "identity_error"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compress(read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry in every round; squares of integers are exact in doubles."""
    assign = """
a{r} AS (SELECT id, part, min(d * 1024 + entry) AS best FROM (
  SELECT p.id, p.part, b.entry, (list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT AS d
  FROM p JOIN b{r} b USING (part)) GROUP BY id, part),"""
    move = """
m{r} AS (SELECT part, entry, list(c ORDER BY pos)::DOUBLE[] AS x FROM (
  SELECT part, best % 1024 AS entry, pos, floor(sum(c) / count(*)) AS c
  FROM (SELECT part, best, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM p JOIN a{r} USING (id, part))
  GROUP BY part, best % 1024, pos) GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry)),"""
    body = "".join(assign.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    return f"""
WITH v AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
p AS (SELECT id, k AS part, x[k * (len(x) // {parts}) + 1:(k + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) t(k)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, x FROM p
  WHERE id IN (SELECT id FROM v ORDER BY id LIMIT {entries})),{body}
s AS (
  SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM b{rounds})),
e AS (
  SELECT id, string_agg(printf('%02x', (best % 1024)::INT), '' ORDER BY part) AS code, sum(best // 1024)::BIGINT AS error
  FROM a{rounds} GROUP BY id)
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM e JOIN v USING (id), s"""


SQL["op12_ball_codes"] = _codes_sql()


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(read(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "shard_bytes")


def _shards_sql(shards: int = 8) -> str:
    """CRC-32 byte by byte over the reversed polynomial's table, then one window per level of the tree."""
    level = """
w{r} AS (SELECT node, sum(size) AS bytes, max(p0) - min(p0) AS w0, max(p1) - min(p1) AS w1, max(p2) - min(p2) AS w2 FROM l{r} GROUP BY node),
c{r} AS (
  SELECT l.*, w.bytes, CASE WHEN w0 >= w1 AND w0 >= w2 THEN p0 WHEN w1 >= w2 THEN p1 ELSE p2 END AS value
  FROM l{r} l JOIN w{r} w USING (node)),
l{n} AS (
  SELECT id, size, crc, p0, p1, p2, spot AS place, CASE WHEN (2 * before + size) * 2 < 2 * bytes THEN node ELSE node + {half} END AS node FROM (
  SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER o AS spot FROM c{r} WINDOW o AS (PARTITION BY node ORDER BY value, crc, id))),"""
    levels, half = "", shards
    for r in range(shards.bit_length() - 1):
        half //= 2
        levels += level.format(r=r, n=r + 1, half=half)
    last = shards.bit_length() - 1
    return f"""
WITH RECURSIVE bits(i, j, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
  SELECT i, j + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE j < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE j = 8),
d AS (SELECT doc_id AS id, source, lang, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT id, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT)),
         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM d, tab),
z AS (SELECT *, length(bin(size)) * 8 + ('0b' || substr(rpad(bin(size), 4, '0'), 2, 3))::INT AS oct FROM d),
s0 AS (SELECT source, sum(sum(size)) OVER (ORDER BY source NULLS LAST) - sum(size) AS p0 FROM z GROUP BY source),
s1 AS (SELECT lang, sum(sum(size)) OVER (ORDER BY lang NULLS LAST) - sum(size) AS p1 FROM z GROUP BY lang),
s2 AS (SELECT oct, sum(sum(size)) OVER (ORDER BY oct) - sum(size) AS p2 FROM z GROUP BY oct),
l0 AS (
  SELECT id, size, crc, p0, p1, p2, 0 AS place, 0 AS node FROM z JOIN crc USING (id) JOIN s0 ON z.source IS NOT DISTINCT FROM s0.source
  JOIN s1 ON z.lang IS NOT DISTINCT FROM s1.lang JOIN s2 USING (oct)),{levels}
f AS (SELECT * FROM l{last})
SELECT id AS doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, node::INT AS shard,
       (place - min(place) OVER (PARTITION BY node))::BIGINT AS slot, NULL::INT AS grown_shard,
       (sum(size) OVER (PARTITION BY node))::BIGINT AS shard_bytes FROM f"""


SQL["op13_kd_shards"] = _shards_sql()


QUERIES = {f.__name__: f for f in (
    op1_ego_join, op2_line_dedup, op3_block_naming, op4_hyper_lang, op5_mixing, op6_setsketch, op7_packing,
    op8_suffix_lm, op9_licences, op10_html_tree, op11_cholesky_whitening, op12_ball_codes, op13_kd_shards)}
