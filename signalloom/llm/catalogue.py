"""One query per operator over the shared tables, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import burst_trie, chunk_dedup, decontaminate, fair_mix, imatch, interpolation, language_id, license_scan, line_runs
from . import merkle, neighbour_tiles, simhash, suffix_levels
from .blocks import remainder

QUERIES = {}
ORACLE = {}


def _query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_language_id(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    dictionaries = language_id.learn(docs.where(~held_out))
    return language_id.predict(docs.drop("lang"), dictionaries).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__verdict.lang").alias("lang_pred"),
        F.col("__verdict.score").alias("score"),
        F.col("__verdict.margin").alias("margin"),
        F.col("__verdict.rejected").alias("rejected"),
    )


@_query()
def op2_interpolation(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    rest = F.coalesce(remainder("doc_id", 40), F.lit(0))
    # one training document in eight is deleted for the weights
    return interpolation.scores(docs, train=F.coalesce(rest % 5 != 1, F.lit(True)), deleted=rest < 5)


_LINES = r"""
WITH lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) a) b),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last AS gone FROM keyed k LEFT JOIN heavy h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


@_query(_LINES)
def op3_line_dedup(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return line_runs.dedup(docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


@_query()
def op4_imatch(spark, d):
    return imatch.compare_edits(_table(spark, d, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        imatch.shown(F.col("print")).alias("fingerprint"),
        imatch.shown(F.col("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


_MIX = r"""
WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS queue,
  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sizes AS (SELECT queue, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY queue),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY queue) - 1) % 3 + 1] AS weight,
  source_size * 3.0::DOUBLE AS most FROM sizes),
rates AS (SELECT *, (sum(source_size) OVER ()
   - (sum(most) OVER (ORDER BY most / weight, queue ROWS UNBOUNDED PRECEDING) - most))
  / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY most / weight, queue ROWS UNBOUNDED PRECEDING) - weight)) AS rate
  FROM weighed),
goals AS (SELECT queue, source_size, least(most, weight * (SELECT rate FROM rates WHERE rate * weight <= most
  ORDER BY most / weight, queue LIMIT 1)) AS target FROM rates),
queued AS (SELECT doc_id, queue, place, size, source_size, target, CAST(sum(size) OVER (PARTITION BY queue ORDER BY place
  ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS bef, CAST(floor(target) AS BIGINT) AS quota FROM sized JOIN goals USING (queue)),
copies AS (SELECT *, e * source_size + bef AS a, e * source_size + bef + size AS b
  FROM queued, (SELECT unnest([0, 1, 2]) AS e) x WHERE size > 0 AND target > 0),
entries AS (SELECT queue, place, bef, a, CASE WHEN a < quota AND quota < b THEN quota ELSE b END AS z, target FROM copies
  UNION ALL SELECT queue, place, bef, quota, b, target FROM copies WHERE a < quota AND quota < b),
summed AS (SELECT *, CAST(sum(z - a) OVER (ORDER BY z / target, queue, z ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM entries),
taken AS (SELECT queue, place, bef, CAST(sum(greatest(0, (z - a) - greatest(0, upto - (SELECT sum(size) FROM sized)))) AS BIGINT)
  AS taken FROM summed GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN taken t ON q.queue = t.queue AND q.place = t.place AND q.bef = t.bef AND q.size > 0"""


@_query(_MIX)
def op5_fair_mix(spark, d):
    return fair_mix.mix(_table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op6_chunk_dedup(spark, d):
    return chunk_dedup.repeated_passages(_table(spark, d, "documents"))


@_query()
def op7_simhash(spark, d):
    return simhash.near_duplicates(_table(spark, d, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_query()
def op8_license_scan(spark, d):
    return license_scan.scan(_table(spark, d, "documents"))


_LEAKS = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
  array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n) x),
found AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.win = b.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query(_LEAKS)
def op9_decontaminate(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return decontaminate.report(docs, _table(spark, d, "benchmark"))


@_query()
def op10_suffix_levels(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return suffix_levels.remove_repeats(docs).drop("kept")


_TILES = r"""
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM good),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
  list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) / (q.norm * c.norm) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5"""


@_query(_TILES)
def op12_neighbour_tiles(spark, d):
    vectors = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbour_tiles.nearest(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def _crc32(text: str) -> str:
    """crc32 of an ASCII string as a DuckDB expression."""
    bits = "list_reduce([xor(acc, byte)] || CAST(range(8) AS UBIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS UBIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS UBIGINT)] || {codes}, lambda acc, byte: {bits}), 4294967295)"


_MANIFEST = rf"""
WITH RECURSIVE claims AS (SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed FROM documents),
framed AS (SELECT doc_id, text, claimed, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS q,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM claims),
leaves AS (SELECT doc_id, q, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claim FROM framed),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY q) AS n FROM leaves),
nodes AS (SELECT q, 0 AS lvl, i, leaf AS digest, n FROM placed
  UNION ALL SELECT q, lvl + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY q, lvl, i // 16, n),
subroots AS (SELECT q, digest, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, i, digest, n FROM subroots
  UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, i // 16, n),
near AS (SELECT p.q, p.i AS leaf_i, x.lvl, x.i, x.digest, CAST(floor(p.i / power(16, x.lvl)) AS BIGINT) AS own FROM placed p
  JOIN nodes x ON x.q = p.q AND x.n > 1 AND x.i // 16 = CAST(floor(p.i / power(16, x.lvl + 1)) AS BIGINT)
  UNION ALL SELECT p.q, p.i, 1000 + x.lvl, x.i, x.digest, CAST(floor(s.i / power(16, x.lvl)) AS BIGINT) FROM placed p JOIN subroots s ON s.q = p.q
  JOIN tops x ON x.n > 1 AND x.i // 16 = CAST(floor(s.i / power(16, x.lvl + 1)) AS BIGINT)),
proofs AS (SELECT q, leaf_i, sha256(coalesce(string_agg(digest, '' ORDER BY lvl, i) FILTER (WHERE i <> own), '')) AS proof_sha256 FROM near GROUP BY q, leaf_i),
steps AS (SELECT q, leaf_i, row_number() OVER (PARTITION BY q, leaf_i ORDER BY lvl) AS step, bef, aft FROM (SELECT q, leaf_i, lvl,
  coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i < own), '') AS bef,
  coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i > own), '') AS aft FROM near GROUP BY q, leaf_i, lvl) g),
folds AS (SELECT q, i AS leaf_i, CAST(1 AS BIGINT) AS step, claim AS acc FROM placed
  UNION ALL SELECT f.q, f.leaf_i, f.step + 1, sha256(bef || acc || aft) FROM folds f JOIN steps s ON s.q = f.q AND s.leaf_i = f.leaf_i AND s.step = f.step),
ends AS (SELECT q, leaf_i, arg_max(acc, step) AS folded_root FROM folds GROUP BY q, leaf_i)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = r.digest AS verified
FROM placed p JOIN subroots s ON s.q = p.q JOIN (SELECT digest FROM tops WHERE n = 1) r ON true
JOIN ends e ON e.q = p.q AND e.leaf_i = p.i LEFT JOIN proofs o ON o.q = p.q AND o.leaf_i = p.i"""


@_query(_MANIFEST)
def op13_merkle(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(remainder("doc_id", 5) == 0, lower).otherwise(F.col("text"))
    return merkle.manifest(docs, claims={"text": tampered}).withColumnRenamed("id", "doc_id")


_TRIE = rf"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role,
  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(k := md5(strlen(role) || ':' || role || text), n := length(text)) ORDER BY p) AS l FROM turns GROUP BY c),
plan AS (SELECT o.c, o.l, CAST({_crc32("CAST(o.c AS VARCHAR)")} % 6 AS INTEGER) AS h, b.l AS first FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
seqs AS (SELECT c, CASE WHEN first IS NULL OR h = 0 THEN l[h + 1:] ELSE list_concat(first[1:h], l[h + 1:]) END AS s FROM plan),
pre AS (SELECT c, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) AS key, CASE WHEN d = 0 THEN 0 ELSE s[d].n END AS n, len(s) = d AS done
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs) x),
nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, max(n) AS chars,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE done), '')) AS ends_sha256 FROM pre GROUP BY d, key),
tied AS (SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN pre p ON p.c = n.conv_id AND p.d = n.d - 1
  LEFT JOIN nodes u ON u.d = p.d AND u.key = p.key),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM tied WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tied t LEFT JOIN kids USING (conv_id, d)),
sums AS (SELECT a.d, a.key, count_if(x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved FROM full_nodes x
  JOIN pre a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.d, a.key)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (d, key)"""


@_query(_TRIE)
def op11_burst_trie(spark, d):
    turns, convs = burst_trie.rebuilt(burst_trie.numbered(_table(spark, d, "conversations")))
    return burst_trie.prefix_trie(turns, convs)
