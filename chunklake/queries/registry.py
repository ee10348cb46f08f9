"""Queries over the registry's log and its manifests, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunklake.common import key, stored, table, written
from chunklake.functions import predicates as P
from chunklake.functions.scalars import gguf_set, words
from chunklake.operators import registry as R
from chunklake.queries.problems import _K, CHAIN

QUERY = "of checkpoint"
AT = 1747000000
HALF = "2025-04-15"


def _c(spark, d):
    """The effective claims, a view made once for each version of the log: most queries read it, several times."""
    return stored(table(spark, d, "log"), "claims", R.claims)


def names_latest(spark, d):
    return R.names(_c(spark, d)).select("registry", "name", "rev", "root", "time", "seq", "publisher")


def resolve_main(spark, d):
    return R.names(_c(spark, d)).filter("rev = 'main'").select("registry", "name", "root", "seq")


def registry_owners(spark, d):
    return R.owners(_c(spark, d))


def registry_blocked(spark, d):
    return R.blocked(_c(spark, d))


def registry_gates(spark, d):
    return R.gates(_c(spark, d))


def registry_anchors(spark, d):
    return R.anchors(_c(spark, d))


def registry_delegate(spark, d):
    return R.delegate(_c(spark, d))


def registry_ticket_issuers(spark, d):
    c = _c(spark, d)
    operators = c.filter("seq = 0").select("registry", F.col("signer").alias("key"))
    return R.ticket_issuers(c, operators, AT)


def registry_index(spark, d):
    return R.index(_c(spark, d)).select("registry", "name", "rev", "root", "time", "gated", "rank")


def registry_search(spark, d):
    return R.search(_c(spark, d), QUERY).select("registry", "name", "rev", "score", "rank")


def registry_search_listed(spark, d):
    h = R.search(_c(spark, d), "checkpoint")
    s = R.summaries(table(spark, d, "manifests"), table(spark, d, "chunks"))
    return R.listed(h, s).select("registry", "name", "rev", "size", "rank", "place")


def registry_search_site(spark, d):
    return R.search_latest(_c(spark, d), "checkpoint").select("registry", "name", "rev", "score", "rank")


def registry_by_name(spark, d):
    return R.by_name(_c(spark, d)).select("registry", "name", "newest", F.array_join("revs", ",").alias("revs"))


def registry_head(spark, d):
    return R.head(stored(table(spark, d, "log"), "chain", R.chain))


def registry_follow(spark, d):
    """A follower that knows what was received before a moment goes on from its heads: entries taken over, and its heads afterwards."""
    log = table(spark, d, "log")
    heads = written(R.head(R.chain(log.filter(F.col("received") < F.lit(HALF).cast("timestamp_ntz")))), "heads")
    new, after = R.follow(heads, log)
    n = new.groupBy("registry").agg(F.count(F.lit(1)).alias("taken"))
    return after.join(n, "registry", "left").select("registry", "size", "hash", F.coalesce("taken", F.lit(0)).alias("taken"))


def _heads(c):
    """A head at every entry, every second one false."""
    return c.select("registry", (F.col("seq") + 1).alias("size"), F.when(F.col("seq") % 2 == 0, F.col("own")).otherwise("x").alias("hash"))


def registry_audit(spark, d):
    """A head at every entry of the chains, also of those without effect."""
    c = stored(table(spark, d, "log"), "chain", R.chain)
    return R.audit(c, _heads(c))


def registry_chain_breaks(spark, d):
    return R.chain_breaks(table(spark, d, "log"))


def registry_page(spark, d):
    rows = table(spark, d, "log").filter("statement is not null").select("registry", "seq", "prev").distinct()
    return R.page(rows, 100, R.PAGE)


def registry_claims_by_kind(spark, d):
    return _c(spark, d).groupBy("registry", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def registry_validate(spark, d):
    """Which statements of the chains are accepted, and why the others aren't; the operator is the signer of the first anchors."""
    c = written(R.claims(table(spark, d, "log"), repeated=True), "claims")
    operators = c.filter("kind = 'anchors'").groupBy("registry").agg(F.min_by("signer", "seq").alias("key"))
    return R.validate(c, operators)


def registry_publish_check(spark, d):
    c = _c(spark, d)
    one = c.filter("kind = 'publish'").select("registry", "seq", "name", "rev", key("root").alias("root"))
    ok, refused = R.publish(one, table(spark, d, "manifests"), R.blocked(c).select("hash"))
    return ok.withColumn("refused", F.lit("")).unionByName(refused).select("registry", "seq", "refused")


def registry_enforced(spark, d):
    m = table(spark, d, "manifests").select(key("root").alias("root"), "model").distinct()
    return R.without_blocked(m, R.blocked(_c(spark, d)), "root")


def model_summary(spark, d):
    s = R.summaries(table(spark, d, "manifests"), table(spark, d, "chunks"))
    return s.withColumn("formats", F.array_join("formats", ","))


def model_files_by_size(spark, d):
    return R.files_by_size(table(spark, d, "manifests"))


def model_list(spark, d):
    m = table(spark, d, "manifests").select(key("root").alias("root"), "files").dropDuplicates(["root"])
    total = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + f["size"])
    return m.select("root", total.alias("size"), F.array_join(F.array_sort(F.transform("files", lambda f: f["path"])), " ").alias("names"))


def gguf_sets(spark, d):
    """Parameters of GGUF models, a byte of a file standing for one, by the rule for sets of shards."""
    m = table(spark, d, "manifests").select(key("root").alias("root"), "files").filter("root is not null").groupBy("root").agg(F.min_by("files", F.to_json("files")).alias("files"))
    return R.gguf_params(m.select("root", F.explode("files").alias("f")).select("root", "f.path", F.col("f.size").alias("params")))


def gguf_shards(spark, d):
    m = table(spark, d, "manifests").select(F.explode("files.path").alias("path")).distinct()
    return m.select("path", gguf_set(F.col("path")).alias("g")).select("path", "g.stem", "g.total")


def unsafe_files(spark, d):
    paths = table(spark, d, "chunks").select("path").filter("path is not null").distinct()
    odd = paths.select(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit(".PT")).alias("path"))
    every = paths.unionByName(odd).distinct()
    return every.select("path", P.is_unsafe(F.col("path")).alias("unsafe"), P.is_unsafe_path(F.col("path")).alias("leaves"))


def valid_names(spark, d):
    m = table(spark, d, "manifests").select(F.explode(F.array("model", F.concat("model", F.lit("@v1")), F.concat(F.lit("."), "model"), F.regexp_replace("model", "/", ""))).alias("ref"))
    m = m.filter("ref is not null").distinct()
    r = P.parse_ref(F.col("ref"))
    return m.select("ref", P.is_name(F.col("ref")).alias("is_name"), r["name"].alias("name"), r["rev"].alias("rev"))


def valid_keys(spark, d):
    k = table(spark, d, "receipts").select("root").distinct()
    return k.select("root", P.is_hash(F.col("root")).alias("raw_ok"), P.is_hash(key("root")).alias("ok"), P.is_meta_key(F.coalesce("root", F.lit(""))).alias("meta"))


def description_words(spark, d):
    n = R.names(_c(spark, d)).select(F.explode(F.array_distinct(F.concat(words(F.col("name")), words(F.col("description"))))).alias("word"))
    return n.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        names_latest, resolve_main, registry_owners, registry_blocked, registry_gates, registry_anchors, registry_delegate, registry_ticket_issuers,
        registry_index, registry_search, registry_search_listed, registry_search_site, registry_by_name, registry_head, registry_follow, registry_audit,
        registry_chain_breaks, registry_page, registry_claims_by_kind, registry_validate, registry_publish_check, registry_enforced, model_summary,
        model_files_by_size, model_list, gguf_sets, gguf_shards, unsafe_files, valid_names, valid_keys, description_words,
    )
}

_NAMES = f""", nm AS (
  SELECT registry, c.name AS name, c.rev AS rev, {_K.format("c.root")} AS root, coalesce(c.description, '') AS description, st.time AS time, seq, signer AS publisher
  FROM effective WHERE c.kind = 'publish' AND c.name IS NOT NULL AND c.rev IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY registry, c.name, c.rev ORDER BY seq DESC) = 1
), bl AS (
  SELECT registry, hash, reason FROM (
    SELECT registry, {_K.format("c.hash")} AS hash, c.kind AS kind, c.reason AS reason, row_number() OVER (PARTITION BY registry, {_K.format("c.hash")} ORDER BY seq DESC) AS r
    FROM effective WHERE c.kind IN ('block', 'unblock')) WHERE r = 1 AND kind = 'block' AND hash IS NOT NULL
), gt AS (
  SELECT registry, root, repo FROM (
    SELECT registry, root, repo, row_number() OVER (PARTITION BY registry, root ORDER BY seq DESC) AS r FROM (
      SELECT registry, {_K.format("c.root")} AS root, c.gated AS repo, seq FROM effective WHERE c.kind = 'publish' AND c.gated IS NOT NULL
      UNION ALL SELECT registry, {_K.format("c.root")}, coalesce(trim(c.repo), ''), seq FROM effective WHERE c.kind = 'gate')) WHERE r = 1 AND repo <> '' AND root IS NOT NULL
), hits AS (
  SELECT nm.*, gt.repo AS gated FROM nm LEFT JOIN gt ON gt.registry = nm.registry AND gt.root = nm.root
  WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.registry = nm.registry AND bl.hash = nm.root)
)
"""
_V = CHAIN + _NAMES
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _search(query: str, source: str = "hits") -> str:
    terms = query.split()
    a = [f"len(list_filter({_WORDS.format('name')}, lambda w: starts_with(w, '{t}'))) > 0" for t in terms]
    b = [f"len(list_filter({_WORDS.format('description')}, lambda w: starts_with(w, '{t}'))) > 0" for t in terms]
    score = " + ".join(f"2 * CAST({x} AS INTEGER) + CAST({y} AS INTEGER)" for x, y in zip(a, b))
    every = " AND ".join(f"({x} OR {y})" for x, y in zip(a, b))
    return f"""SELECT *, {score} AS score, CAST(row_number() OVER (PARTITION BY registry ORDER BY {score} DESC, time DESC, name, rev) AS INTEGER) AS rank FROM {source}
      WHERE {every} QUALIFY rank <= {R.SEARCHED}"""


_FILES = f"(SELECT DISTINCT ON (root) {_K.format('root')} AS root, files FROM manifests WHERE {_K.format('root')} IS NOT NULL)"
_SUMMARY = f"""
f AS (SELECT root, unnest(files, recursive := true) FROM {_FILES.replace('DISTINCT ON (root)', f"DISTINCT ON ({_K.format('root')})")}),
a AS (
  SELECT root, CAST(sum(size) AS BIGINT) AS size, CAST(coalesce(sum(size) FILTER (WHERE ext IN ('safetensors', 'gguf')), 0) AS BIGINT) AS weights,
    coalesce(array_to_string(list_sort(list_distinct(list(ext) FILTER (WHERE ext IN ('safetensors', 'gguf')))), ','), '') AS formats, count(*) AS files
  FROM (SELECT root, size, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM f) GROUP BY root
),
ch AS (SELECT DISTINCT chunk_id, {_K.format('root')} AS root, {_K.format('hash')} AS hash, len FROM chunks WHERE {_K.format('root')} IS NOT NULL),
u AS (
  SELECT root, CAST(sum(n) AS BIGINT) AS chunks, count(hash) AS unique_chunks, CAST(coalesce(sum(len) FILTER (WHERE hash IS NOT NULL), 0) AS BIGINT) AS unique_bytes
  FROM (SELECT root, hash, count(*) AS n, max(len) AS len FROM ch GROUP BY root, hash) GROUP BY root
),
summary AS (
  SELECT a.*, coalesce(chunks, 0) AS chunks, coalesce(unique_chunks, 0) AS unique_chunks, coalesce(unique_bytes, 0) AS unique_bytes FROM a LEFT JOIN u USING (root)
)"""
_F1 = _FILES.replace("DISTINCT ON (root)", f"DISTINCT ON ({_K.format('root')})")

_PART = "[A-Za-z0-9_-][A-Za-z0-9._-]{{0,{0}}}"
_NAME_OK = f"coalesce(regexp_full_match(c.name, '{_PART.format(63)}/{_PART.format(95)}') AND regexp_full_match(c.rev, '{_PART.format(63)}'), false)"
_REPO_OK = lambda x: f"coalesce(regexp_full_match({x}, '{_PART.format(95)}/{_PART.format(95)}'), false)"
_HASH_OK = lambda x: f"coalesce(regexp_full_match({x}, '[0-9a-f]{{64}}'), false)"

#: SQL of the acceptance rules: operator statements by windows, orgs by a walk over their statements in step
_VALIDATE = f""", every AS (
  SELECT e.registry, e.seq, e.st.claim AS c, e.st.claim.kind AS kind, e.st.signature.key AS signer, e.st.signature.sig AS sig, e.st.time AS told FROM entries e JOIN back b USING (registry, seq, own)
), boss AS (SELECT registry, arg_min(signer, seq) AS boss FROM every WHERE kind = 'anchors' GROUP BY registry),
x AS (SELECT every.*, boss FROM every LEFT JOIN boss USING (registry)),
d AS (
  SELECT *, CASE WHEN NOT coalesce(signer = boss, false) THEN 'not the operator' WHEN coalesce(c.key, '') = '' THEN '' WHEN NOT {_HASH_OK("c.key")} THEN 'invalid key'
    WHEN NOT coalesce(c.expires > told, false) THEN 'expired' WHEN c.key = boss THEN 'delegates to itself' ELSE '' END AS dwhy FROM x
), f AS (
  SELECT *, last_value(CASE WHEN kind = 'delegate' AND dwhy = '' THEN {{'k': c.key, 'e': c.expires}} END IGNORE NULLS) OVER (PARTITION BY registry ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deal FROM d
), a AS (SELECT *, coalesce(signer = boss OR (deal.k <> '' AND signer = deal.k AND told < deal.e), false) AS acts FROM f),
o AS (
  SELECT *, CASE WHEN kind = 'delegate' THEN dwhy WHEN NOT acts THEN 'not the operator'
    WHEN kind IN ('block', 'unblock') THEN CASE WHEN NOT {_HASH_OK(_K.format("c.hash"))} THEN 'invalid hash' ELSE '' END
    WHEN kind = 'gate' THEN CASE WHEN NOT {_HASH_OK(_K.format("c.root"))} THEN 'invalid root' WHEN coalesce(trim(c.repo), '') <> '' AND NOT {_REPO_OK("trim(c.repo)")} THEN 'invalid gate' ELSE '' END
    ELSE CASE WHEN len(c.addrs) > {R.MAX_ANCHORS} THEN 'too many anchors' WHEN len(list_filter(c.addrs, lambda z: NOT regexp_matches(z, '/p2p/[A-Za-z0-9]+$'))) > 0 THEN 'invalid anchor' ELSE '' END END AS owhy
  FROM a WHERE kind IN ('delegate', 'block', 'unblock', 'gate', 'anchors')
), od AS (
  SELECT *, CASE WHEN coalesce(bool_or(owhy = '') OVER (PARTITION BY registry, sig ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'repeated' ELSE owhy END AS refused FROM o
), mk AS (SELECT registry, {_K.format("c.hash")} AS root, seq, kind = 'block' AS up FROM od WHERE refused = '' AND kind IN ('block', 'unblock')),
p AS (
  SELECT registry, seq, kind, signer, sig, c.key AS member, CASE WHEN kind = 'publish' THEN split_part(c.name, '/', 1) ELSE c.org END AS org,
    CASE WHEN kind = 'publish' THEN CASE WHEN c.gated IS NOT NULL AND NOT {_REPO_OK("c.gated")} THEN 'invalid gate' WHEN NOT {_NAME_OK} THEN 'invalid name'
      WHEN NOT {_HASH_OK(_K.format("c.root"))} THEN 'invalid root' WHEN strlen(c.description) > {R.MAX_DESCRIPTION} THEN 'description too long'
      WHEN coalesce((SELECT arg_max(up, mk.seq) FROM mk WHERE mk.registry = x.registry AND mk.root = {_K.format("x.c.root")} AND mk.seq < x.seq), false) THEN 'blocked' ELSE '' END
    WHEN kind = 'grant' AND NOT {_HASH_OK("c.key")} THEN 'invalid key' ELSE '' END AS pwhy
  FROM x WHERE kind IN ('publish', 'grant', 'revoke')
), q AS (SELECT *, row_number() OVER (PARTITION BY registry, org ORDER BY seq) AS i FROM p),
walk AS (
  SELECT registry, org, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, '' AS kind, 'start' AS refused, CAST([] AS VARCHAR[]) AS own, CAST([] AS VARCHAR[]) AS sigs FROM (SELECT DISTINCT registry, org FROM q)
  UNION ALL
  SELECT registry, org, i, seq, kind, why, CASE WHEN why <> '' THEN own WHEN kind = 'publish' THEN CASE WHEN len(own) = 0 THEN [signer] ELSE own END
      WHEN kind = 'grant' THEN list_append(own, member) ELSE list_filter(own, lambda z: z <> member) END, CASE WHEN why = '' THEN list_append(sigs, sig) ELSE sigs END
  FROM (
    SELECT q.*, w.own, w.sigs, CASE WHEN list_contains(w.sigs, q.sig) THEN 'repeated' WHEN pwhy <> '' THEN pwhy
      WHEN q.kind = 'publish' THEN CASE WHEN len(w.own) > 0 AND NOT list_contains(w.own, q.signer) THEN 'not an owner' ELSE '' END
      WHEN len(w.own) = 0 THEN 'no such org' WHEN NOT list_contains(w.own, q.signer) THEN 'not an owner'
      WHEN q.kind = 'grant' THEN CASE WHEN list_contains(w.own, member) THEN 'owns it already' ELSE '' END
      WHEN NOT coalesce(list_contains(w.own, member), false) THEN 'no owner' WHEN len(w.own) = 1 THEN 'last owner' ELSE '' END AS why
    FROM walk w JOIN q ON q.registry = w.registry AND q.org IS NOT DISTINCT FROM w.org AND q.i = w.i + 1
  )
) SELECT registry, seq, kind, refused FROM walk WHERE seq >= 0 UNION ALL SELECT registry, seq, kind, refused FROM od
UNION ALL SELECT registry, seq, kind, 'unknown kind' FROM x WHERE kind IS NULL OR kind NOT IN ('publish', 'grant', 'revoke', 'delegate', 'block', 'unblock', 'gate', 'anchors')"""

SQL = {
    "registry_validate": CHAIN + _VALIDATE,
    "names_latest": _V + "SELECT registry, name, rev, root, time, seq, publisher FROM nm",
    "resolve_main": _V + "SELECT registry, name, root, seq FROM nm WHERE rev = 'main'",
    "registry_owners": CHAIN
    + """, ev AS (
  SELECT registry, split_part(c.name, '/', 1) AS org, signer AS key, seq, true AS up FROM effective WHERE c.kind = 'publish' AND c.name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY registry, split_part(c.name, '/', 1) ORDER BY seq) = 1
  UNION ALL SELECT registry, c.org, c.key, seq, c.kind = 'grant' FROM effective WHERE c.kind IN ('grant', 'revoke') AND c.org IS NOT NULL AND c.key IS NOT NULL
) SELECT registry, org, key FROM (SELECT *, row_number() OVER (PARTITION BY registry, org, key ORDER BY seq DESC) AS r FROM ev) WHERE r = 1 AND up""",
    "registry_blocked": _V + "SELECT registry, hash, reason FROM bl",
    "registry_gates": _V + "SELECT registry, root, repo FROM gt",
    "registry_anchors": CHAIN + "SELECT registry, unnest(c.addrs) AS addr FROM (SELECT * FROM effective WHERE c.kind = 'anchors' QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq DESC) = 1)",
    "registry_delegate": CHAIN + "SELECT registry, c.key AS key, c.expires AS expires FROM (SELECT * FROM effective WHERE c.kind = 'delegate' QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq DESC) = 1) WHERE c.key <> ''",
    "registry_ticket_issuers": CHAIN
    + f"""SELECT registry, signer AS key FROM effective WHERE seq = 0 UNION SELECT registry, c.key FROM (
  SELECT * FROM effective WHERE c.kind = 'delegate' QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq DESC) = 1) WHERE c.key <> '' AND c.expires > {AT}""",
    "registry_index": _V + "SELECT registry, name, rev, root, time, gated, CAST(row_number() OVER (PARTITION BY registry ORDER BY time DESC, name, rev) AS INTEGER) AS rank FROM hits",
    "registry_search": _V + f"SELECT registry, name, rev, score, rank FROM ({_search(QUERY)})",
    "registry_search_listed": _V + "," + _SUMMARY
    + f" SELECT registry, name, rev, size, rank, CAST(row_number() OVER (PARTITION BY registry ORDER BY rank) AS INTEGER) AS place FROM ({_search('checkpoint')}) h JOIN summary s ON h.root = s.root QUALIFY place <= {R.SHOWN}",
    "registry_search_site": _V
    + f", latest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY registry, name ORDER BY time DESC, rev DESC) = 1) SELECT registry, name, rev, score, rank FROM ({_search('checkpoint', 'latest')})",
    "registry_by_name": _V + "SELECT registry, name, max(time) AS newest, string_agg(rev, ',' ORDER BY time DESC, rev DESC) AS revs FROM hits GROUP BY registry, name",
    "registry_head": CHAIN + "SELECT registry, max(seq) + 1 AS size, arg_max(own, seq) AS hash FROM back GROUP BY registry",
    "registry_audit": CHAIN + "SELECT registry, seq + 1 AS size, seq % 2 = 0 AS ok FROM back",
    "registry_follow": f"""
WITH RECURSIVE entries AS (
  SELECT registry, seq, {_K.format("prev")} AS prev, sha256(concat_ws('|', CAST(seq AS VARCHAR), prev, statement.signature.sig)) AS own, min(received) AS received
  FROM log WHERE statement.signature.sig IS NOT NULL AND seq IS NOT NULL GROUP BY registry, seq, log.prev, statement.signature.sig
), early AS (SELECT * FROM entries WHERE received < TIMESTAMP '{HALF}'),
c1 AS (
  SELECT registry, seq, own FROM early WHERE seq = 0 AND prev = repeat('0', 64)
  UNION ALL SELECT e.registry, e.seq, e.own FROM c1 JOIN early e ON e.registry = c1.registry AND e.seq = c1.seq + 1 AND e.prev = c1.own
), h AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq DESC, own) = 1),
d AS (SELECT registry, seq, own FROM h UNION ALL SELECT e.registry, e.seq, e.own FROM d JOIN entries e ON e.registry = d.registry AND e.seq = d.seq + 1 AND e.prev = d.own),
z AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq DESC, own) = 1)
SELECT z.registry, z.seq + 1 AS size, z.own AS hash, z.seq - h.seq AS taken FROM z JOIN h USING (registry)""",
    "registry_chain_breaks": f"""
WITH e AS (
  SELECT registry, seq, {_K.format("prev")} AS prev,
    CASE WHEN statement IS NOT NULL THEN sha256(concat_ws('|', CAST(seq AS VARCHAR), prev, statement.signature.sig)) END AS own, received
  FROM log WHERE seq IS NOT NULL
), one AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY registry, seq ORDER BY own IS NULL, received NULLS LAST, prev NULLS FIRST, own NULLS FIRST) = 1
), w AS (SELECT *, lag(seq) OVER (PARTITION BY registry ORDER BY seq) AS before, lag(own) OVER (PARTITION BY registry ORDER BY seq) AS expected FROM one)
SELECT registry, seq, coalesce(seq - before <> 1, seq <> 0) AS gap, CASE WHEN before IS NULL THEN prev <> repeat('0', 64) ELSE coalesce(prev <> expected, true) END AS forged
FROM w WHERE gap OR forged""",
    "registry_page": f"""SELECT registry, seq, prev FROM (SELECT DISTINCT registry, seq, prev FROM log WHERE statement IS NOT NULL AND seq >= 100)
QUALIFY row_number() OVER (PARTITION BY registry ORDER BY seq) <= {R.PAGE}""",
    "registry_claims_by_kind": CHAIN + "SELECT registry, c.kind AS kind, count(*) AS n, min(st.time) AS first, max(st.time) AS last FROM effective GROUP BY ALL",
    "registry_publish_check": _V
    + f""", m AS (SELECT {_K.format("root")} AS root, list_filter(any_value(files), lambda f: regexp_matches(lower(f.path), '\\.(bin|pt|pth|ckpt|pkl|pickle|joblib|dill|pd|npy|npz|h5|hdf5|keras)$')) AS bad FROM manifests GROUP BY 1)
SELECT e.registry, e.seq, CASE WHEN NOT regexp_full_match(coalesce(r, ''), '[0-9a-f]{{64}}') THEN 'invalid root' WHEN m.root IS NULL THEN 'no manifest' WHEN r IN (SELECT hash FROM bl) THEN 'blocked'
  WHEN len(m.bad) > 0 THEN 'unsafe: ' || m.bad[1].path WHEN NOT (regexp_full_match(e.c.name, '[A-Za-z0-9_-][A-Za-z0-9._-]{{0,63}}/[A-Za-z0-9_-][A-Za-z0-9._-]{{0,95}}')
  AND regexp_full_match(e.c.rev, '[A-Za-z0-9_-][A-Za-z0-9._-]{{0,63}}')) THEN 'invalid name' ELSE '' END AS refused
FROM (SELECT *, {_K.format("c.root")} AS r FROM effective WHERE c.kind = 'publish') e LEFT JOIN m ON m.root = e.r""",
    "registry_enforced": _V + f"SELECT DISTINCT {_K.format('root')} AS root, model FROM manifests WHERE {_K.format('root')} NOT IN (SELECT hash FROM bl)",
    "model_summary": "WITH " + _SUMMARY + " SELECT * FROM summary",
    "model_files_by_size": f"SELECT root, path, size, CAST(row_number() OVER (PARTITION BY root ORDER BY size DESC, path) AS INTEGER) AS rank FROM (SELECT root, unnest(files, recursive := true) FROM {_F1})",
    "model_list": f"SELECT root, CAST(list_sum(list_transform(files, lambda f: f.size)) AS BIGINT) AS size, array_to_string(list_sort(list_transform(files, lambda f: f.path)), ' ') AS names FROM {_F1}",
    "gguf_sets": f"""WITH mo AS (SELECT root, arg_min(files, CAST(to_json(files) AS VARCHAR)) AS files FROM (SELECT {_K.format("root")} AS root, files FROM manifests) WHERE root IS NOT NULL GROUP BY root),
s AS (
  SELECT root, coalesce(nullif(regexp_extract(path, '^(.*)-[0-9]{{5}}-of-([0-9]{{5}})\\.gguf$', 1), ''), path) AS stem,
    coalesce(TRY_CAST(regexp_extract(path, '^(.*)-[0-9]{{5}}-of-([0-9]{{5}})\\.gguf$', 2) AS INTEGER), 1) AS total, path, size
  FROM (SELECT root, unnest(files, recursive := true) FROM mo) WHERE path LIKE '%.gguf'
), g AS (SELECT root, stem, count(*) AS n, sum(size) AS p, arg_min(total, path) AS total FROM s GROUP BY root, stem)
SELECT root, count(*) AS sets, CAST(CASE WHEN bool_and(n = total) AND count(DISTINCT p) = 1 THEN max(p) END AS BIGINT) AS params FROM g GROUP BY root""",
    "gguf_shards": """SELECT path, coalesce(nullif(regexp_extract(path, '^(.*)-[0-9]{5}-of-([0-9]{5})\\.gguf$', 1), ''), path) AS stem,
  coalesce(TRY_CAST(regexp_extract(path, '^(.*)-[0-9]{5}-of-([0-9]{5})\\.gguf$', 2) AS INTEGER), 1) AS total
FROM (SELECT DISTINCT unnest(files).path AS path FROM manifests)""",
    "unsafe_files": """WITH p AS (SELECT DISTINCT path FROM chunks WHERE path IS NOT NULL), e AS (SELECT path FROM p UNION SELECT regexp_replace(path, '\\.[^.]*$', '') || '.PT' FROM p)
SELECT path, regexp_matches(lower(path), '\\.(bin|pt|pth|ckpt|pkl|pickle|joblib|dill|pd|npy|npz|h5|hdf5|keras)$') AS unsafe, regexp_matches(path, '(^|/)(\\.\\.)?(/|$)') AS leaves FROM e""",
    "valid_names": """WITH m AS (SELECT DISTINCT ref FROM (SELECT unnest([model, model || '@v1', '.' || model, replace(model, '/', '')]) AS ref FROM manifests) WHERE ref IS NOT NULL),
x AS (SELECT ref, regexp_full_match(ref, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}/[A-Za-z0-9_-][A-Za-z0-9._-]{0,95}') AS is_name, split_part(ref, '@', 1) AS n,
  CASE WHEN contains(ref, '@') THEN split_part(ref, '@', 2) ELSE 'main' END AS r FROM m)
SELECT ref, is_name, CASE WHEN regexp_full_match(n, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}/[A-Za-z0-9_-][A-Za-z0-9._-]{0,95}') THEN n END AS name,
  CASE WHEN regexp_full_match(n, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}/[A-Za-z0-9_-][A-Za-z0-9._-]{0,95}') THEN r END AS rev FROM x""",
    "valid_keys": f"""SELECT DISTINCT root, coalesce(regexp_full_match(root, '[0-9a-f]{{64}}'), false) AS raw_ok, coalesce(regexp_full_match({_K.format("root")}, '[0-9a-f]{{64}}'), false) AS ok,
  regexp_full_match(coalesce(root, ''), '[A-Za-z0-9._%-]+(/[A-Za-z0-9._%-]+)*') AS meta FROM receipts""",
    "description_words": _V + f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat({_WORDS.format('name')}, {_WORDS.format('description')}))) AS word FROM nm) GROUP BY word",
}
