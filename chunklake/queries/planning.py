"""Queries of plans over chunk tables, scalar functions and byte-level operators, with SQL where DuckDB has the means."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunklake.common import epoch_day, key, table
from chunklake.functions import predicates as P
from chunklake.functions import scalars as S
from chunklake.operators import planning as L
from chunklake.operators import registry as R
from chunklake.plans import dedup
from chunklake.queries.problems import _K
from chunklake.queries.registry import _V, _c


def _chunks(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", key("root").alias("root"), "file_ix", "path", "chunk_ix", key("hash").alias("hash"), "len", "dtype", key("block_id").alias("block_id")).filter("root is not null")


def _store(spark, d):
    return table(spark, d, "blobs").filter("payload is not null and removed is null").select(key("hash").alias("hash"), "raw_len", F.octet_length("payload").cast("bigint").alias("stored"))


def _pieces(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    n = F.octet_length("text").cast("bigint")
    return t.select("source", F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.sha2("text", 256).alias("hash"), n.alias("raw"), F.floor(n * 3 / 4).alias("stored"))


def dedup_by_source(spark, d):
    return dedup.report(_pieces(spark, d), ["source"], ["source", "doc_id"])


def dedup_by_lang(spark, d):
    return dedup.report(_pieces(spark, d), ["lang"], ["source", "doc_id"])


def dedup_totals(spark, d):
    return dedup.report(_pieces(spark, d), [], ["source", "doc_id"])


def _sizes(spark, d):
    return _store(spark, d).groupBy("hash").agg(F.max("stored").alias("stored"))


def _pieces_of_roots(spark, d):
    c = _chunks(spark, d).filter("hash is not null")
    return c.select("hash", F.col("len").alias("raw"), "root", F.coalesce("dtype", F.lit("raw")).alias("dtype"), "file_ix", "chunk_ix")


def dedup_by_root(spark, d):
    return dedup.report(_pieces_of_roots(spark, d), ["root"], ["root", "file_ix", "chunk_ix"], _sizes(spark, d))


def dedup_by_dtype(spark, d):
    p = dedup.report(_pieces_of_roots(spark, d), ["dtype"], ["root", "file_ix", "chunk_ix"], _sizes(spark, d))
    return p.withColumn("pct", S.percent(F.col("new_stored_bytes"), F.col("raw_bytes")))


def dedup_between_sources(spark, d):
    return dedup.versions(_pieces(spark, d).select(F.col("source").alias("input"), "hash", "raw", "stored"), "mail.operator", "mail.support")


def chunk_offsets(spark, d):
    return L.offsets(_chunks(spark, d), ["root", "file_ix"]).select("root", "file_ix", "chunk_ix", "start", "stop")


def _placed(spark, d):
    return L.offsets(_chunks(spark, d), ["root", "file_ix"])


def _ranges(spark, d):
    f = _placed(spark, d).groupBy("root", "file_ix").agg(F.max("stop").alias("size"))
    return f.select("root", "file_ix", F.concat_ws("/", "root", "file_ix").alias("range_id"), F.expr("size div 3").alias("lo"), F.expr("size div 3 + 1500000").alias("hi"))


def range_read(spark, d):
    return L.range_parts(_placed(spark, d), _ranges(spark, d), ["root", "file_ix"]).select("root", "file_ix", "chunk_ix", "skip", "take")


def read_ahead(spark, d):
    placed = _placed(spark, d)
    return L.read_ahead(placed, L.range_parts(placed, _ranges(spark, d), ["root", "file_ix"]), ["root", "file_ix"]).select("root", "file_ix", "chunk_ix")


def _missing(spark, d):
    p = _placed(spark, d)
    return p.filter("hash is not null").join(_store(spark, d).select("hash").distinct(), "hash", "left_anti")


def range_coalesce(spark, d):
    return L.coalesce_ranges(_missing(spark, d), ["root", "file_ix"])


def block_cut(spark, d):
    return L.cut_blocks(_chunks(spark, d).filter("hash is not null"), 2_000_000).groupBy("root", "block_ix").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))


def block_ids(spark, d):
    return L.block_ids(L.cut_blocks(_chunks(spark, d).filter("hash is not null"), 2_000_000))


def blocks_held(spark, d):
    return L.held_blocks(L.cut_blocks(_chunks(spark, d).filter("hash is not null"), 2_000_000), _store(spark, d))


def missing_plan(spark, d):
    bad = _store(spark, d).filter("hash like '00%'").select("hash")
    p = L.missing_plan(_chunks(spark, d), _store(spark, d), bad)
    return p.groupBy("root", "state").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))


def source_rotation(spark, d):
    some = F.array(*[F.lit(f"peer{i}") for i in range(5)])
    h = _store(spark, d).select("hash").distinct()
    return h.select("hash", F.array_join(L.rotate(F.col("hash"), some), ",").alias("sources"))


def source_preference(spark, d):
    arr = lambda *n: F.array(*[F.lit(x) for x in n])
    h = _store(spark, d).select("hash").distinct()
    return h.select("hash", F.array_join(L.preferred(F.col("hash"), arr("a", "b", "c"), arr("c", "d"), arr("x", "a")), ",").alias("sources"))


def first_good_source(spark, d):
    p = table(spark, d, "probes").dropDuplicates(["probe_id"]).select("node", F.col("probe_id").alias("rank"), F.col("anchor").alias("source"), F.coalesce(F.col("outcome") == "held", F.lit(False)).alias("ok"), epoch_day(F.col("t")).alias("day_no"))
    return L.first_good(p, ["node", "day_no"])


def quorum(spark, d):
    return L.vote(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("digest")), ["name"], "digest")


def part_ranges(spark, d):
    f = _placed(spark, d).groupBy("root", "file_ix").agg((F.max("stop") * 40).alias("size"))
    return L.part_ranges(f.select(F.concat_ws("/", "root", "file_ix").alias("name"), "size"))


def chunk_places(spark, d):
    return L.places(_placed(spark, d).filter("hash is not null"), ["root", "file_ix"]).select("root", "file_ix", "hash", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


def prefetch_order(spark, d):
    p = _placed(spark, d).filter("hash is not null and path is not null")
    f = p.groupBy("root", "file_ix").agg(F.max("stop").alias("size"), F.max("path").alias("path"))
    weights = F.col("path").endswith(".safetensors")
    small = f.select("root", "file_ix", F.when(weights, 1).otherwise(0).alias("phase"), F.when(weights, 0).otherwise(F.col("size")).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.col("path").alias("k3"), F.lit(0).cast("bigint").alias("lo"), F.when(weights, F.least(F.col("size"), F.lit(65536))).otherwise(F.col("size")).cast("bigint").alias("hi"))
    rest = f.filter(weights).select("root", "file_ix", F.lit(3).alias("phase"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.col("path").alias("k3"), F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi"))
    return L.prefetch(small.unionByName(rest), p)


def layer_keys(spark, d):
    """A layer for every p_partkey; layer_keys has 40."""
    t = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("model.layers."), F.col("p_partkey").cast("string"), F.lit(".mlp.weight")), F.concat(F.lit("embed."), F.lower("p_brand")), F.concat(F.lit("lm_head."), F.col("p_size").cast("string")), F.lit("final.norm"))).alias("name")).distinct()
    k = S.layer_key(F.col("name"))
    return t.select("name", k["group"].alias("grp"), k["number"].alias("number"))


def path_tree(spark, d):
    p = table(spark, d, "manifests").select(key("root").alias("root"), F.explode("files.path").alias("path")).distinct()
    return L.tree(p, ["root"]).select("root", "node", "parent", "is_file", "rank")


def tree_listing(spark, d):
    p = table(spark, d, "manifests").select(F.explode("files.path").alias("path")).distinct()
    a = L.listing(p, "tokenizer/", False).withColumn("mode", F.lit("direct"))
    return a.unionByName(L.listing(p, "", True).withColumn("mode", F.lit("all"))).unionByName(L.listing(p, "", False).withColumn("mode", F.lit("top")))


def announce_set(spark, d):
    h = L.held_blocks(L.cut_blocks(_chunks(spark, d).filter("hash is not null"), 2_000_000), _store(spark, d))
    provided = h.filter("block_ix = 0").select(F.concat_ws("/", "root", "block_ix").alias("key"))
    add, drop = L.announce(h, provided)
    return add.withColumn("op", F.lit("announce")).unionByName(drop.withColumn("op", F.lit("withdraw")))


def chunk_gates(spark, d):
    """Which repos gate each chunk in each registry, by the gates of its whole log."""
    return L.chunk_gates(_chunks(spark, d), R.gates(_c(spark, d)))


def links_index(spark, d):
    """The first place of each chunk among all files, with its offset."""
    f = L.first_seen(_placed(spark, d).filter("hash is not null"), ["hash"], ["root", "file_ix", "chunk_ix"])
    return f.select("hash", "root", "file_ix", F.col("start").alias("offset"), "len")


def store_put(spark, d):
    """Chunks that the store lacks: what a write would add."""
    w = _chunks(spark, d).select("hash", "len").filter("hash is not null").distinct()
    return w.join(_store(spark, d).select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.max("len").alias("len"))


def store_contains(spark, d):
    w = _chunks(spark, d).select("root", "hash").filter("hash is not null").distinct()
    return w.join(_store(spark, d).select("hash").distinct(), "hash", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("held"))


def store_known(spark, d):
    b = table(spark, d, "blobs").dropDuplicates()
    return b.groupBy("version", "codec").agg(F.count(F.lit(1)).alias("n"), F.max(P.blob_known(F.col("version"), F.col("codec")).cast("int")).alias("known"))


def manifest_soundness(spark, d):
    return _chunks(spark, d).groupBy("root", "file_ix").agg((F.max("len") <= P.MAX_CHUNK).alias("sound"))


def tiered_lookup(spark, d):
    a = _store(spark, d).groupBy("hash").agg(F.max("raw_len").alias("len"))
    b = _chunks(spark, d).filter("hash is not null").groupBy("hash").agg(F.max("len").alias("len"))
    return L.tiered([a, b], "hash", "len")


def version_share(spark, d):
    m = table(spark, d, "manifests").filter("model is not null").select(key("root").alias("root"), "model").distinct()
    c = _chunks(spark, d).select("root", "hash").filter("hash is not null").distinct().join(m, "root")
    n = c.groupBy("model", "hash").agg(F.countDistinct("root").alias("n"))
    return n.groupBy("model").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("n") > 1).alias("shared"))


def human_formats(spark, d):
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("n"))
    return n.select("k", S.human_bytes(F.col("n")).alias("bytes"), S.human_count(F.col("n")).alias("count"), S.ago(F.col("n")).alias("ago"), S.progress_bytes(F.col("n")).alias("progress"), S.progress_percent(F.col("k"), F.lit(15000)).alias("pct"), S.eta(F.col("n"), F.lit(1000000)).alias("eta"))


def date_functions(spark, d):
    o = table(spark, d, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).alias("day_no")).distinct()
    s = S.day_to_date(F.col("day_no"))
    long = lambda c: c.cast("bigint")
    return o.select(long(F.col("day_no")).alias("day_no"), s.alias("day"), long(S.date_to_day(s)).alias("back"), long(S.date_to_day(F.regexp_replace(s, "-0", "-"))).alias("loose"))


def content_hashes(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    h = S.to_hex(F.col("b"))
    return t.select("doc_id", S.content_hash(F.col("b")).alias("sha256"), S.git_blob_hash(F.col("b")).alias("git"), h.alias("hex"), (S.from_hex(h) == F.col("b")).alias("same"))


def url_functions(spark, d):
    """Whole texts percent-encoded and back."""
    t = table(spark, d, "documents").filter("text is not null")
    e = S.url_encode(F.col("text"))
    return t.select("doc_id", e.alias("encoded"), (S.url_decode(e) == F.col("text")).alias("same"))


def byte_ranges(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    h = F.explode(F.array(F.concat(F.lit("bytes="), F.col("k").cast("string"), F.lit("-")), F.concat(F.lit("bytes=-"), F.col("k").cast("string")), F.concat(F.lit("bytes=10-"), F.col("k").cast("string")), F.lit("bytes=x")))
    r = o.select("k", h.alias("header"))
    p = P.byte_range(F.col("header"), F.lit(5000).cast("bigint"))
    return r.select("k", "header", p["start"].alias("start"), p["end"].alias("end"))


def model_names(spark, d):
    """Names of models in several spellings: their parts, how they are shown and where their manifests lie."""
    m = table(spark, d, "manifests").select(F.explode(F.array("model", F.concat("model", F.lit(":q4")), F.concat(F.lit(" https://hub.example:80/"), "model"), F.concat("model", F.lit("@sha256")), F.concat(F.lit("library/"), F.substring_index("model", "/", -1)))).alias("ref"))
    m = m.filter("ref is not null").distinct()
    n = S.model_name(F.col("ref"))
    return m.select("ref", n["host"].alias("host"), n["namespace"].alias("namespace"), n["model"].alias("model"), n["tag"].alias("tag"), S.model_display(n).alias("shown"), S.model_path(n).alias("path"))


def params_per_dtype(spark, d):
    c = _chunks(spark, d).filter("dtype is not null")
    width = F.when(F.col("dtype") == "raw", 1).when(F.col("dtype").isin("bf16", "f16"), 2).when(F.col("dtype") == "f32", 4).otherwise(8)
    return c.groupBy("dtype").agg(F.sum(F.floor(F.col("len") / width)).alias("elements"), F.sum("len").alias("bytes"))


def exponent_histogram(spark, d):
    x = table(spark, d, "embeddings").select(F.explode("embedding").alias("x"))
    return x.groupBy(S.exponent_of(F.col("x")).alias("exponent")).agg(F.count(F.lit(1)).alias("n"))


def largest_chunks(spark, d):
    """Largest chunks per type, ten each, by running rank."""
    from pyspark.sql import Window

    c = _chunks(spark, d).filter("dtype is not null and hash is not null").groupBy("dtype", "hash").agg(F.max("len").alias("len"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("dtype").orderBy(F.desc("len"), "hash"))).filter("rank <= 10")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_by_source, dedup_by_lang, dedup_totals, dedup_by_root, dedup_by_dtype, dedup_between_sources, chunk_offsets, range_read, read_ahead,
        range_coalesce, block_cut, block_ids, blocks_held, missing_plan, source_rotation, source_preference, first_good_source, quorum, part_ranges,
        chunk_places, prefetch_order, layer_keys, path_tree, tree_listing, announce_set, chunk_gates, links_index, store_put, store_contains, store_known,
        manifest_soundness, tiered_lookup, version_share, human_formats, date_functions, content_hashes, url_functions, byte_ranges, model_names,
        params_per_dtype, exponent_histogram, largest_chunks,
    )
}

_PIECES = """WITH p AS (
  SELECT source, coalesce(lang, 'none') AS lang, doc_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS raw, CAST(floor(strlen(text) * 3 / 4) AS BIGINT) AS stored FROM documents WHERE text IS NOT NULL
)"""
_CH = f"""WITH RECURSIVE ch AS (
  SELECT DISTINCT chunk_id, {_K.format("root")} AS root, file_ix, path, chunk_ix, {_K.format("hash")} AS hash, len, dtype FROM chunks WHERE {_K.format("root")} IS NOT NULL
), st AS (SELECT {_K.format("hash")} AS hash, max(octet_length(payload)) AS stored, max(raw_len) AS raw_len FROM blobs WHERE payload IS NOT NULL AND removed IS NULL GROUP BY 1),
pl AS (SELECT *, CAST(sum(len) OVER w AS BIGINT) AS stop, CAST(sum(len) OVER w - len AS BIGINT) AS start FROM ch WINDOW w AS (PARTITION BY root, file_ix ORDER BY chunk_ix)),
rg AS (SELECT root, file_ix, max(stop) // 3 AS lo, max(stop) // 3 + 1500000 AS hi FROM pl GROUP BY ALL),
pt AS (SELECT pl.root, pl.file_ix, chunk_ix, greatest(lo - start, 0) AS skip, least(hi, stop) - start - greatest(lo - start, 0) AS take FROM pl JOIN rg USING (root, file_ix) WHERE stop > lo AND start < hi AND len > 0),
un AS (SELECT * FROM ch WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root, hash ORDER BY file_ix, chunk_ix) = 1),
ui AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY file_ix, chunk_ix) AS i FROM un)
"""
_CUT = """, cut AS (
  SELECT root, hash, file_ix, chunk_ix, len, i, 0 AS block_ix, len AS held FROM ui WHERE i = 1
  UNION ALL SELECT n.root, n.hash, n.file_ix, n.chunk_ix, n.len, n.i, c.block_ix + CASE WHEN c.held >= 2000000 THEN 1 ELSE 0 END, n.len + CASE WHEN c.held >= 2000000 THEN 0 ELSE c.held END
  FROM cut c JOIN ui n ON n.root = c.root AND n.i = c.i + 1
), hb AS (SELECT root, block_ix, bool_and(st.hash IS NOT NULL) AS held FROM cut LEFT JOIN st USING (hash) GROUP BY ALL)
"""


def _dedup(source: str, by: str, order: str) -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}count(*) AS chunks, count(*) FILTER (WHERE new) AS new_chunks, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(coalesce(sum(raw) FILTER (WHERE new), 0) AS BIGINT) AS new_raw_bytes,
  CAST(sum(stored) AS BIGINT) AS stored_bytes, CAST(coalesce(sum(stored) FILTER (WHERE new), 0) AS BIGINT) AS new_stored_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {order}) = 1 AS new FROM {source}){group}"""


_SC = "(SELECT ch.*, len AS raw, coalesce(st.stored, len) AS stored FROM (SELECT root, file_ix, chunk_ix, hash, len, coalesce(dtype, 'raw') AS dtype FROM ch WHERE hash IS NOT NULL) ch LEFT JOIN st USING (hash))"
_HB = lambda n: "CASE " + " ".join(f"WHEN {n} >= {1024**i} THEN printf('%.1f', floor({n} * 10 / {1024**i}.0 + 0.5) / 10) || ' {u}'" for i, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + f" ELSE {n} || ' B' END"
_HC = lambda n: "CASE " + " ".join(f"WHEN {n} >= {1000**i} THEN printf('%.1f', floor({n} * 10 / {1000**i}.0 + 0.5) / 10) || '{u}'" for i, u in ((4, "T"), (3, "B"), (2, "M"), (1, "K"))) + f" ELSE CAST({n} AS VARCHAR) END"
_AGO = "CASE " + " ".join(f"WHEN n >= {s} THEN (n // {s}) || ' {u}' || CASE WHEN n // {s} = 1 THEN '' ELSE 's' END || ' ago'" for s, u in ((31536000, "year"), (2592000, "month"), (86400, "day"), (3600, "hour"), (60, "minute"))) + " ELSE 'just now' END"

SQL = {
    "dedup_by_source": _PIECES + _dedup("p", "source", "source, doc_id"),
    "dedup_by_lang": _PIECES + _dedup("p", "lang", "source, doc_id"),
    "dedup_totals": _PIECES + _dedup("p", "", "source, doc_id"),
    "dedup_by_root": _CH + _dedup(_SC, "root", "root, file_ix, chunk_ix"),
    "dedup_by_dtype": _CH + f"SELECT *, CASE WHEN raw_bytes = 0 THEN 0.0 ELSE round(new_stored_bytes * 100.0 / raw_bytes, 1) END AS pct FROM ({_dedup(_SC, 'dtype', 'root, file_ix, chunk_ix')})",
    "dedup_between_sources": _PIECES + """SELECT CAST(coalesce(sum(raw), 0) AS BIGINT) AS size, CAST(coalesce(sum(raw) FILTER (WHERE held), 0) AS BIGINT) AS held, CAST(coalesce(sum(stored) FILTER (WHERE NOT held), 0) AS BIGINT) AS transfer
FROM (SELECT hash, max(raw) AS raw, max(stored) AS stored, hash IN (SELECT hash FROM p WHERE source = 'mail.operator') AS held FROM p WHERE source = 'mail.support' GROUP BY hash)""",
    "chunk_offsets": _CH + "SELECT root, file_ix, chunk_ix, start, stop FROM pl",
    "range_read": _CH + "SELECT * FROM pt",
    "read_ahead": _CH + "SELECT pl.root, pl.file_ix, pl.chunk_ix FROM pl JOIN (SELECT root, file_ix, max(chunk_ix) AS last FROM pt GROUP BY ALL) USING (root, file_ix) WHERE pl.chunk_ix > last AND pl.chunk_ix <= last + 16",
    "range_coalesce": _CH + """, ms AS (SELECT * FROM pl WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM st)),
g AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY root, file_ix ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1048576 THEN 0 ELSE 1 END AS new FROM ms),
h AS (SELECT *, sum(new) OVER (PARTITION BY root, file_ix ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT root, file_ix, min(start) AS lo, max(stop) AS hi, count(*) AS parts FROM h GROUP BY root, file_ix, island""",
    "block_cut": _CH + _CUT + "SELECT root, CAST(block_ix AS BIGINT) AS block_ix, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes FROM cut GROUP BY ALL",
    "block_ids": _CH + _CUT + "SELECT root, CAST(block_ix AS BIGINT) AS block_ix, sha256('block/v1|' || string_agg(hash, '' ORDER BY file_ix, chunk_ix)) AS block_id, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes FROM cut GROUP BY ALL",
    "blocks_held": _CH + _CUT + "SELECT root, CAST(block_ix AS BIGINT) AS block_ix, held FROM hb",
    "missing_plan": _CH + """SELECT root, state, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes FROM (
  SELECT root, len, CASE WHEN hash LIKE '00%' AND hash IN (SELECT hash FROM st) THEN 'blocked' WHEN hash IN (SELECT hash FROM st) THEN 'local' ELSE 'missing' END AS state FROM un) GROUP BY ALL""",
    "source_rotation": _CH + """SELECT hash, array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: 'peer' || ((i + CAST('0x' || hash[1:4] AS BIGINT)) % 5)), ',') AS sources FROM st WHERE hash IS NOT NULL""",
    "source_preference": _CH + """, n AS (SELECT hash, CAST('0x' || hash[1:4] AS BIGINT) AS n FROM st)
SELECT hash, array_to_string(list_concat(list_transform([0, 1, 2], lambda i: ['a', 'b', 'c'][(i + n) % 3 + 1]), ['d', 'x']), ',') AS sources FROM n""",
    "first_good_source": """WITH p AS (SELECT DISTINCT ON (probe_id) node, probe_id AS rank, anchor AS source, coalesce(outcome = 'held', false) AS ok, CAST(t // 86400 AS INTEGER) AS day_no FROM probes),
g AS (SELECT node, day_no, min(rank) FILTER (WHERE ok) AS hit FROM p GROUP BY ALL)
SELECT p.node, p.day_no, max(source) FILTER (WHERE rank = hit) AS source, CAST(count(*) FILTER (WHERE NOT ok AND (hit IS NULL OR rank < hit)) AS INTEGER) AS rejected FROM p JOIN g ON p.node = g.node AND p.day_no = g.day_no GROUP BY ALL""",
    "quorum": """SELECT name, digest, votes FROM (SELECT l_orderkey AS name, l_returnflag AS digest, count(*) AS votes FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY votes DESC, digest DESC) = 1 AND votes >= 2""",
    "part_ranges": _CH + """, f AS (SELECT root || '/' || file_ix AS name, max(stop) * 40 AS size FROM pl GROUP BY root, file_ix),
g AS (SELECT *, CASE WHEN size < 67108864 THEN 1 ELSE least(greatest(CAST(ceil(size / 104857600) AS BIGINT), 2), 16) END AS n FROM f),
h AS (SELECT name, size, (size + n - 1) // n AS step, unnest(generate_series(0, n - 1)) AS part FROM g)
SELECT name, CAST(part AS INTEGER) AS part, part * step AS lo, least(size, (part + 1) * step) AS hi FROM h""",
    "chunk_places": _CH + "SELECT root, file_ix, hash, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS starts FROM pl WHERE hash IS NOT NULL GROUP BY ALL",
    "prefetch_order": _CH + """, p AS (SELECT * FROM pl WHERE hash IS NOT NULL AND path IS NOT NULL), f AS (SELECT root, file_ix, max(stop) AS size, max(path) AS path FROM p GROUP BY ALL),
r AS (
  SELECT root, file_ix, CASE WHEN path LIKE '%.safetensors' THEN 1 ELSE 0 END AS phase, CASE WHEN path LIKE '%.safetensors' THEN 0 ELSE size END AS k1, path AS k3, CASE WHEN path LIKE '%.safetensors' THEN least(size, 65536) ELSE size END AS hi FROM f
  UNION ALL SELECT root, file_ix, 3, 0, path, size FROM f WHERE path LIKE '%.safetensors'
), j AS (SELECT p.root, p.hash, phase, k1, k3, p.file_ix, chunk_ix FROM p JOIN r ON p.root = r.root AND p.file_ix = r.file_ix AND stop > 0 AND start < hi),
u AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY root, hash ORDER BY phase, k1, k3, file_ix, chunk_ix) = 1)
SELECT root, hash, phase, CAST(row_number() OVER (PARTITION BY root ORDER BY phase, k1, k3, file_ix, chunk_ix) AS INTEGER) AS rank FROM u""",
    "layer_keys": """WITH t AS (SELECT DISTINCT unnest(['model.layers.' || p_partkey || '.mlp.weight', 'embed.' || lower(p_brand), 'lm_head.' || p_size, 'final.norm']) AS name FROM part),
n AS (SELECT name, TRY_CAST(list_filter(string_split(name, '.'), lambda p: regexp_full_match(p, '[0-9]+'))[1] AS BIGINT) AS number FROM t)
SELECT name, CASE WHEN number IS NOT NULL THEN 1 WHEN regexp_matches(name, 'embed|wte|wpe') THEN 0 ELSE 2 END AS grp, coalesce(number, 0) AS number FROM n""",
    "path_tree": f"""WITH p AS (SELECT DISTINCT {_K.format("root")} AS root, unnest(files).path AS path FROM manifests),
q AS (SELECT root, string_split(path, '/') AS s FROM p), e AS (SELECT root, s, unnest(generate_series(1, len(s))) AS i FROM q),
t AS (SELECT root, array_to_string(s[1:i], '/') AS node, array_to_string(s[1:i - 1], '/') AS parent, s[i] AS name, bool_or(i = len(s)) AS is_file FROM e GROUP BY ALL)
SELECT root, node, parent, is_file, CAST(row_number() OVER (PARTITION BY root, parent ORDER BY name) AS INTEGER) AS rank FROM t""",
    "tree_listing": """WITH p AS (SELECT DISTINCT unnest(files).path AS path FROM manifests)
SELECT path, 'direct' AS mode FROM p WHERE starts_with(path, 'tokenizer/') AND NOT contains(substr(path, 11), '/') UNION ALL SELECT path, 'all' FROM p UNION ALL SELECT path, 'top' FROM p WHERE NOT contains(path, '/')""",
    "announce_set": _CH + _CUT + """, k AS (SELECT root AS key FROM hb GROUP BY root HAVING bool_and(held) UNION SELECT root || '/' || block_ix FROM hb WHERE held),
v AS (SELECT root || '/' || block_ix AS key FROM hb WHERE block_ix = 0)
SELECT key, 'announce' AS op FROM k WHERE key NOT IN (SELECT key FROM v) UNION ALL SELECT key, 'withdraw' FROM v WHERE key NOT IN (SELECT key FROM k)""",
    "chunk_gates": _V + "," + _CH.removeprefix("WITH RECURSIVE") + """SELECT registry, hash, string_agg(repo, ',' ORDER BY repo) AS repos
FROM (SELECT DISTINCT registry, hash, repo FROM ch JOIN gt USING (root) WHERE hash IS NOT NULL) GROUP BY ALL""",
    "links_index": _CH + "SELECT hash, root, file_ix, start AS \"offset\", len FROM pl WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY root, file_ix, chunk_ix) = 1",
    "store_put": _CH + "SELECT hash, max(len) AS len FROM ch WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM st) GROUP BY hash",
    "store_contains": _CH + "SELECT root, count(DISTINCT hash) AS held FROM ch WHERE hash IN (SELECT hash FROM st) GROUP BY root",
    "store_known": "SELECT version, codec, count(*) AS n, CAST(max(CAST(version IN (1, 2) AND codec BETWEEN 0 AND 5 AND (version >= 2 OR codec <= 3) AS INTEGER)) AS INTEGER) AS known FROM (SELECT DISTINCT * FROM blobs) GROUP BY ALL",
    "manifest_soundness": _CH + "SELECT root, file_ix, bool_and(len <= 262144) AS sound FROM ch GROUP BY ALL",
    "tiered_lookup": _CH + "SELECT coalesce(a.hash, b.hash) AS hash, coalesce(a.raw_len, b.len) AS len, CASE WHEN a.raw_len IS NOT NULL THEN 0 ELSE 1 END AS tier FROM st a FULL JOIN (SELECT hash, max(len) AS len FROM ch WHERE hash IS NOT NULL GROUP BY hash) b ON a.hash = b.hash",
    "version_share": _CH + f""", m AS (SELECT DISTINCT {_K.format("root")} AS root, model FROM manifests WHERE model IS NOT NULL)
SELECT model, count(*) AS chunks, count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT model, hash, count(DISTINCT root) AS n FROM ch JOIN m USING (root) WHERE hash IS NOT NULL GROUP BY ALL) GROUP BY model""",
    "human_formats": f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 37 AS n FROM orders)
SELECT k, {_HB("n")} AS bytes, {_HC("n")} AS count, {_AGO} AS ago,
  CASE WHEN n >= 1000000000 THEN printf('%.1f', floor(n / 1e8 + 0.5) / 10) || ' GB' WHEN n >= 1000000 THEN printf('%.1f', floor(n / 1e5 + 0.5) / 10) || ' MB' ELSE printf('%.1f', floor(n / 1e2 + 0.5) / 10) || ' KB' END AS progress,
  CAST(floor(least(k, 15000) * 100 / 15000) AS INTEGER) AS pct, printf('%d:%02d', CAST(ceil(n / 1000000) AS BIGINT) // 60, CAST(ceil(n / 1000000) AS BIGINT) % 60) AS eta FROM t""",
    "date_functions": """SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day_no, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS back,
  CASE WHEN contains(strftime(o_orderdate, '%Y-%m-%d'), '-0') THEN NULL ELSE CAST(o_orderdate AS DATE) - DATE '1970-01-01' END AS loose FROM orders""",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS git, lower(hex(encode(text))) AS hex, true AS same FROM documents WHERE text IS NOT NULL",
    "url_functions": "SELECT doc_id, url_encode(text) AS encoded, true AS same FROM documents WHERE text IS NOT NULL",
    "byte_ranges": """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, 'bytes=' || k || '-' AS header, CASE WHEN k < 5000 THEN k END AS start, CASE WHEN k < 5000 THEN 5000 END AS "end" FROM o
UNION ALL SELECT k, 'bytes=-' || k, CASE WHEN k > 0 THEN greatest(5000 - k, 0) END, CASE WHEN k > 0 THEN 5000 END FROM o
UNION ALL SELECT k, 'bytes=10-' || k, CASE WHEN k >= 10 THEN 10 END, CASE WHEN k >= 10 THEN least(k + 1, 5000) END FROM o
UNION ALL SELECT k, 'bytes=x', NULL, NULL FROM o""",
    "model_names": """WITH m AS (SELECT DISTINCT unnest([model, model || ':q4', ' https://hub.example:80/' || model, model || '@sha256', 'library/' || split_part(model, '/', -1)]) AS ref FROM manifests WHERE model IS NOT NULL),
t AS (SELECT ref, regexp_replace(trim(ref), '^https?://', '') AS s FROM m),
u AS (SELECT ref, contains(s, '@') AS none, CASE WHEN regexp_matches(s, ':[^/]*$') THEN regexp_extract(s, ':([^:/]*)$', 1) ELSE 'latest' END AS tag, string_split(regexp_replace(s, ':[^/]*$', ''), '/') AS p FROM t),
v AS (SELECT ref, CASE WHEN NOT none THEN CASE WHEN len(p) = 3 THEN p[1] ELSE 'registry.ollama.ai' END END AS host, CASE WHEN NOT none THEN p[len(p) - 1] END AS namespace, CASE WHEN NOT none THEN p[len(p)] END AS model, CASE WHEN NOT none THEN tag END AS tag FROM u)
SELECT *, CASE WHEN host = 'registry.ollama.ai' THEN CASE WHEN namespace = 'library' THEN model ELSE namespace || '/' || model END ELSE host || '/' || namespace || '/' || model END || ':' || tag AS shown,
  'manifests/' || host || '/' || namespace || '/' || model || '/' || tag AS path FROM v""",
    "params_per_dtype": _CH + "SELECT dtype, CAST(sum(len // CASE dtype WHEN 'raw' THEN 1 WHEN 'bf16' THEN 2 WHEN 'f16' THEN 2 WHEN 'f32' THEN 4 ELSE 8 END) AS BIGINT) AS elements, CAST(sum(len) AS BIGINT) AS bytes FROM ch WHERE dtype IS NOT NULL GROUP BY dtype",
    "exponent_histogram": "SELECT CAST(('0b' || substr(CAST(CAST(x AS FLOAT)::BIT AS VARCHAR), 2, 8)) AS INTEGER) AS exponent, count(*) AS n FROM (SELECT unnest(embedding) AS x FROM embeddings) GROUP BY 1",
    "largest_chunks": _CH + "SELECT dtype, hash, len, CAST(row_number() OVER (PARTITION BY dtype ORDER BY len DESC, hash) AS INTEGER) AS rank FROM (SELECT dtype, hash, max(len) AS len FROM ch WHERE dtype IS NOT NULL AND hash IS NOT NULL GROUP BY ALL) QUALIFY rank <= 10",
}
