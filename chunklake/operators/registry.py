"""The registry as queries over its log: names, owners, blocklist, gates, search, index, model summaries, audit.

`claims` gives the effective statements of every log's chain; every view below is an aggregation over it, latest entry first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.common import key, rank_within, written
from chunklake.functions import predicates as P
from chunklake.functions.scalars import gguf_set, words
from chunklake.operators.changes import GENESIS, longest_chain, registry_entries

SEARCHED, SHOWN, PAGE = 200, 50, 1000
MAX_DESCRIPTION, MAX_ANCHORS = 2000, 64
BLOCK = 4096


def chain(log: DataFrame) -> DataFrame:
    """registry, seq, own of every entry of the longest chains, also of those that repeat a signature and so have no effect."""
    e = registry_entries(log).filter("own is not null")
    return longest_chain(e).select(F.col("log").alias("registry"), "seq", "own")


def claims(log: DataFrame, repeated: bool = False) -> DataFrame:
    """registry, seq, own, prev, time, signer, sig and the claim's columns of every effective statement on the longest chains;
    with `repeated`, also of those whose signature occurred before."""
    e = registry_entries(log).filter("own is not null")
    s = e.join(longest_chain(e).select("log", "seq", "own"), ["log", "seq", "own"], "left_semi")
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("log", "seq").orderBy(F.col("received").asc_nulls_last()))).filter("r = 1")
    if not repeated:
        s = s.withColumn("r", F.row_number().over(Window.partitionBy("log", "statement.signature.sig").orderBy("seq"))).filter("r = 1")
    return s.select(
        F.col("log").alias("registry"), "seq", "own", "prev", F.col("statement.time").alias("time"), F.col("statement.signature.key").alias("signer"),
        F.col("statement.signature.sig").alias("sig"), "statement.claim.*",
    )


def names(c: DataFrame) -> DataFrame:
    """The latest publish of each name and revision: registry, name, rev, root, description, time, seq, publisher."""
    last = F.max_by(F.struct(key("root").alias("root"), "description", "time", "seq", F.col("signer").alias("publisher")), "seq")
    return c.filter("kind = 'publish' and name is not null and rev is not null").groupBy("registry", "name", "rev").agg(last.alias("v")).select("registry", "name", "rev", "v.*")


def owners(c: DataFrame) -> DataFrame:
    """registry, org, key of the owners at the end: the first publisher, and the grants that weren't revoked later."""
    first = (
        c.filter("kind = 'publish' and name is not null").groupBy("registry", F.substring_index("name", "/", 1).alias("org"))
        .agg(F.min("seq").alias("seq"), F.min_by("signer", "seq").alias("key")).select("registry", "org", "key", "seq", F.lit(True).alias("on"))
    )
    later = c.filter("kind in ('grant', 'revoke')").select("registry", "org", "key", "seq", (F.col("kind") == "grant").alias("on"))
    state = first.unionByName(later).filter("org is not null and key is not null").groupBy("registry", "org", "key").agg(F.max_by("on", F.struct("seq", "on")).alias("on"))
    return state.filter("on").select("registry", "org", "key")


def blocked(c: DataFrame) -> DataFrame:
    s = c.filter("kind in ('block', 'unblock')").groupBy("registry", key("hash").alias("hash")).agg(F.max_by(F.struct("kind", "reason"), "seq").alias("v"))
    return s.filter("v.kind = 'block' and hash is not null").select("registry", "hash", "v.reason")


def gates(c: DataFrame) -> DataFrame:
    """registry, root, repo. A publish without a gate is no event here; an empty repo lifts the gate."""
    ev = c.filter("kind = 'publish' and gated is not null").select("registry", key("root").alias("root"), F.col("gated").alias("repo"), "seq")
    ev = ev.unionByName(c.filter("kind = 'gate'").select("registry", key("root").alias("root"), F.coalesce(F.trim("repo"), F.lit("")).alias("repo"), "seq"))
    return ev.groupBy("registry", "root").agg(F.max_by("repo", "seq").alias("repo")).filter("repo <> '' and root is not null")


def anchors(c: DataFrame) -> DataFrame:
    """registry, addr: the addresses of the latest anchors statement."""
    last = c.filter("kind = 'anchors'").groupBy("registry").agg(F.max_by("addrs", "seq").alias("addrs"))
    return last.select("registry", F.explode("addrs").alias("addr"))


def delegate(c: DataFrame) -> DataFrame:
    """registry, key, expires of the latest delegation; an empty key is none."""
    last = c.filter("kind = 'delegate'").groupBy("registry").agg(F.max_by(F.struct("key", "expires"), "seq").alias("v"))
    return last.filter("v.key <> ''").select("registry", "v.key", "v.expires")


def ticket_issuers(c: DataFrame, operators: DataFrame, at: int) -> DataFrame:
    """registry, key of everyone who may sign tickets at a time: the operator (registry, key), and a delegate that hasn't expired."""
    return operators.select("registry", "key").unionByName(delegate(c).filter(F.col("expires") > at).select("registry", "key")).distinct()


def resolve(c: DataFrame, name: str, rev: str = "main") -> DataFrame:
    """The latest publish of a name; neither the blocklist nor the listed models matter here."""
    return names(c.filter(F.col("name") == name)).filter(F.col("rev") == rev)


def hits(c: DataFrame) -> DataFrame:
    """Every name that isn't blocked, with its gate."""
    n = names(c).join(blocked(c).select("registry", F.col("hash").alias("root")), ["registry", "root"], "left_anti")
    return n.join(gates(c), ["registry", "root"], "left").withColumnRenamed("repo", "gated")


def _score(query: str, name: Column, description: Column) -> tuple[Column, Column]:
    terms = [t for t in re.split(r"[\W_]+", query.lower()) if t]
    n, d = words(name), words(description)
    score, every = F.lit(0), F.lit(True)

    def begins(all_words: Column, t: str) -> Column:
        return F.exists(all_words, lambda w: w.startswith(t))

    for t in terms:
        a, b = begins(n, t), begins(d, t)
        score, every = score + 2 * a.cast("int") + b.cast("int"), every & (a | b)
    return score, every


def search(c: DataFrame, query: str, limit: int = SEARCHED) -> DataFrame:
    """Hits of which every term begins some word of name or description, with rank: score (2 in the name, 1 in the description), then newest, then name and revision. No terms: all, score 0."""
    score, every = _score(query, F.col("name"), F.col("description"))
    h = hits(c).filter(every).withColumn("score", score)
    w = Window.partitionBy("registry").orderBy(F.desc("score"), F.desc("time"), "name", "rev")
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def listed(h: DataFrame, summaries: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Ranked hits that have a summary, the first `limit` of them; the search's own limit came before."""
    w = Window.partitionBy("registry").orderBy("rank")
    return h.join(summaries.select("root", "size"), "root").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def index(c: DataFrame) -> DataFrame:
    """All hits, newest first, ties by name and revision."""
    return rank_within(hits(c), ["registry"], [F.desc("time"), F.asc("name"), F.asc("rev")])


def by_name(c: DataFrame) -> DataFrame:
    """One row per name: its revisions newest first, and the time of the newest, by which names are listed."""
    revs = F.sort_array(F.collect_list(F.struct(F.col("time"), F.col("rev"), F.col("root"))), asc=False)
    return hits(c).groupBy("registry", "name").agg(F.max("time").alias("newest"), F.transform(revs, lambda r: r["rev"]).alias("revs"))


def search_latest(c: DataFrame, query: str, limit: int = SEARCHED) -> DataFrame:
    """The site's search: names by their latest revision only; a blank query gives all."""
    last = hits(c).groupBy("registry", "name").agg(F.max_by(F.struct("rev", "root", "description", "time"), F.struct("time", "rev")).alias("v")).select("registry", "name", "v.*")
    score, every = _score(query, F.col("name"), F.col("description"))
    w = Window.partitionBy("registry").orderBy(F.desc("score"), F.desc("time"), "name")
    return last.filter(every).withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def page(log: DataFrame, start: int, limit: int = PAGE) -> DataFrame:
    w = Window.partitionBy("registry").orderBy("seq")
    return log.filter(F.col("seq") >= start).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")


def chain_breaks(log: DataFrame) -> DataFrame:
    """Where a log read in order isn't a chain: registry, seq, gap (a sequence is missing before it), forged (prev isn't the hash before it).

    One entry per sequence is looked at, the first received."""
    e = registry_entries(log).filter("seq is not null").withColumn("r", F.row_number().over(Window.partitionBy("log", "seq").orderBy(F.col("own").isNull(), F.col("received").asc_nulls_last(), "prev", "own"))).filter("r = 1")
    # a row beside the one before it by joining places, so that no log is one group
    e = written(rank_within(e.select("log", "seq", "prev", "own"), ["log"], [F.asc("seq")], "place"), "entries")
    b = e.select("log", (F.col("place") + 1).alias("place"), F.col("seq").alias("before"), F.col("own").alias("expected"))
    e = e.join(b, ["log", "place"], "left")
    gap = F.coalesce(F.col("seq") - F.col("before") != 1, F.col("seq") != 0)
    forged = F.when(F.col("before").isNull(), F.col("prev") != GENESIS).otherwise(F.coalesce(F.col("prev") != F.col("expected"), F.lit(True)))
    return e.select(F.col("log").alias("registry"), "seq", gap.alias("gap"), forged.alias("forged")).filter("gap or forged")


def head(c: DataFrame) -> DataFrame:
    """registry, size and hash of the last entry of each chain (size counts entries, also those without effect): c is `chain`'s, as claims lack these."""
    return c.groupBy("registry").agg((F.max("seq") + 1).alias("size"), F.max_by("own", "seq").alias("hash"))


def follow(heads: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a follower takes over from another's log: (registry, seq, own) of the entries that extend its heads, and its heads afterwards.

    heads: registry, size, hash of what the follower has (size 0 and 64 zeros for nothing). Only entries that follow a head link by link count:
    of several continuations the longest. Where none does, the head stays as it is; registries without a head aren't followed."""
    e = registry_entries(log).filter("own is not null")
    h = heads.select(F.col("registry").alias("log"), "size", F.col("hash").alias("_hash"))
    at = F.col("seq") - F.col("size")
    first = F.when(F.col("prev") == F.col("_hash"), F.lit(GENESIS))  # at a head's place only what names it as its predecessor can follow
    new = e.join(h, "log").filter(at >= 0).select("log", at.alias("seq"), F.when(at == 0, first).otherwise(F.col("prev")).alias("prev"), "own")
    on = written(longest_chain(new).select("log", "seq", "own"), "followed")
    accepted = on.join(h, "log").select(F.col("log").alias("registry"), (F.col("seq") + F.col("size")).alias("seq"), "own")
    last = accepted.groupBy("registry").agg((F.max("seq") + 1).alias("_size"), F.max_by("own", "seq").alias("_own"))
    after = heads.select("registry", "size", "hash").join(last, "registry", "left")
    return accepted, after.select("registry", F.coalesce("_size", "size").alias("size"), F.coalesce("_own", "hash").alias("hash"))


def audit(c: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether heads (registry, size, hash) seen earlier are those of a prefix of the log; c is `chain`'s."""
    at = c.select("registry", (F.col("seq") + 1).alias("size"), "own")
    return heads.join(at, ["registry", "size"], "left").select("registry", "size", F.coalesce(F.col("own") == F.col("hash"), F.lit(False)).alias("ok"))


def summaries(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per root: size, weights, formats, files, chunks, unique_chunks, unique_bytes. Repeated manifest and chunk rows count once."""
    m = manifests.select(key("root").alias("root"), "files").filter("root is not null").dropDuplicates(["root"])
    f = m.select("root", F.explode("files").alias("f")).select("root", "f.path", "f.size")
    ext = P.extension(F.col("path"))
    weight = ext.isin("safetensors", "gguf")
    a = f.groupBy("root").agg(
        F.sum("size").alias("size"), F.coalesce(F.sum(F.when(weight, F.col("size"))), F.lit(0)).alias("weights"),
        F.array_sort(F.collect_set(F.when(weight, ext))).alias("formats"), F.count(F.lit(1)).alias("files"),
    )
    c = chunks.select("chunk_id", key("root").alias("root"), key("hash").alias("hash"), "len").filter("root is not null").dropDuplicates(["chunk_id"])
    per_hash = c.groupBy("root", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    u = per_hash.groupBy("root").agg(
        F.sum("n").alias("chunks"), F.count("hash").alias("unique_chunks"), F.coalesce(F.sum(F.when(F.col("hash").isNotNull(), F.col("len"))), F.lit(0)).alias("unique_bytes")
    )
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return a.join(u, "root", "left").select("root", "size", "weights", "formats", "files", zero("chunks"), zero("unique_chunks"), zero("unique_bytes"))


def gguf_params(files: DataFrame) -> DataFrame:
    """root, sets, params of GGUF models from (root, path, params): null unless every set of shards is whole and counted and all sets agree."""
    s = files.select("root", "path", "params", gguf_set(F.col("path")).alias("g")).filter("path like '%.gguf'")
    sets = s.groupBy("root", "g.stem").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("g.total", "path").alias("total"), F.sum("params").alias("p"), F.bool_and(F.col("params").isNotNull()).alias("counted")
    )
    return sets.groupBy("root").agg(
        F.count(F.lit(1)).alias("sets"),
        F.when(F.bool_and((F.col("n") == F.col("total")) & F.col("counted")) & (F.countDistinct("p") == 1), F.max("p")).alias("params"),
    )


def model_params(files: DataFrame) -> DataFrame:
    """root, params of models with safetensors or GGUF files (root, path, params; null where a file isn't counted).

    The sum over the safetensors files; where one of them isn't counted, as a number that lacks a shard would be wrong, or there is none, that
    of the GGUF files by the rule of `gguf_params`; else null."""
    s = files.filter("path like '%.safetensors'").groupBy("root")
    s = s.agg(F.when(F.bool_and(F.col("params").isNotNull()), F.sum("params")).cast("bigint").alias("params"))
    g = gguf_params(files).select("root", F.col("params").alias("_gguf"))
    return s.join(g, "root", "full").select("root", F.coalesce("params", "_gguf").alias("params"))


def files_by_size(manifests: DataFrame) -> DataFrame:
    """The files of each root, largest first."""
    m = manifests.select(key("root").alias("root"), "files").filter("root is not null").dropDuplicates(["root"])
    f = m.select("root", F.explode("files").alias("f")).select("root", "f.path", "f.size")
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("size"), "path")))


def without_blocked(df: DataFrame, block: DataFrame, column: str) -> DataFrame:
    """Enforcement of a blocklist: the rows that stay."""
    return df.join(block.select(F.col("hash").alias("_b")).distinct(), key(column) == F.col("_b"), "left_anti")


def check_headers(leading: DataFrame) -> DataFrame:
    """root, path, ok: whether a header's bytes, cut at the lengths of the file's first chunks, hash to them (SHA-256).

    leading: root, path, header (binary, the same on every row of a file), chunk_ix, hash, len. All in built-in functions:
    the offset of a chunk is a running sum, its bytes a substring; a header needn't fill the last chunk it reaches into."""
    w = Window.partitionBy("root", "path").orderBy("chunk_ix")
    at = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = leading.withColumn("at", at).filter(F.col("at") + F.col("len") <= F.octet_length("header"))
    part = F.sha2(F.substring(F.col("header"), F.col("at").cast("int") + 1, F.col("len").cast("int")), 256)
    return c.groupBy("root", "path").agg(F.bool_and(part == F.col("hash")).alias("ok"))


def _unfit() -> Column:
    """Why a publish, grant or revoke is refused whatever came before it; empty when it isn't."""
    gated = F.col("gated").isNotNull() & ~P.is_repo(F.col("gated"))
    return (
        F.when(F.col("kind") == "publish", F.when(gated, "invalid gate").when(~P.is_name(F.col("name")) | ~P.is_rev(F.col("rev")), "invalid name")
               .when(~P.is_hash(key("root")), "invalid root").when(F.octet_length("description") > MAX_DESCRIPTION, "description too long"))
        .when(F.col("kind") == "grant", F.when(~P.is_hash(F.col("key")), "invalid key"))
    )


def in_force(c: DataFrame, delegations: DataFrame) -> DataFrame:
    """Blocks, unblocks, gates and anchors among the claims with agent and until of the latest delegation before each (null without one).

    delegations: registry, seq, key, expires. Their times in force are intervals of sequence numbers; these are joined by blocks of
    numbers, so a registry with half of all entries isn't one group."""
    last = c.groupBy("registry").agg(F.max("seq").alias("last"))
    force = delegations.select("registry", "seq", F.col("key").alias("agent"), F.col("expires").alias("until"))
    force = force.withColumn("next", F.lead("seq").over(Window.partitionBy("registry").orderBy("seq"))).join(last, "registry")
    spans = F.sequence(F.expr(f"seq div {BLOCK}"), F.expr(f"coalesce(next, last) div {BLOCK}"))
    force = force.select("registry", F.col("seq").alias("_from"), F.coalesce("next", F.col("last") + 1).alias("_to"), "agent", "until", F.explode(spans).alias("_block"))
    o = c.filter("kind in ('block', 'unblock', 'gate', 'anchors')").withColumn("_block", F.expr(f"seq div {BLOCK}"))
    same = (F.col("o.registry") == F.col("f.registry")) & (F.col("o._block") == F.col("f._block"))
    o = o.alias("o").join(force.alias("f"), same & (F.col("seq") > F.col("_from")) & (F.col("seq") <= F.col("_to")), "left")
    return o.select(*[F.col(f"o.{x}") for x in c.columns], F.when(F.col("agent") != "", F.col("agent")).alias("agent"), "until")


def _operator_statements(c: DataFrame) -> DataFrame:
    """c with `refused` for delegations, blocks, unblocks, gates and anchors. c: claims with the operator's key.

    Delegations are accepted or not by themselves; who acts for the operator follows from the accepted ones."""
    d = c.filter("kind = 'delegate'")
    given = F.coalesce("key", F.lit("")) != ""
    d = d.withColumn("_why", F.when(~F.coalesce(F.col("signer") == F.col("operator"), F.lit(False)), "not the operator").when(
        given, F.when(~P.is_hash(F.col("key")), "invalid key").when(~F.coalesce(F.col("expires") > F.col("time"), F.lit(False)), "expired").when(F.col("key") == F.col("operator"), "delegates to itself")
    ))
    o = in_force(c, d.filter("_why is null"))
    acts = P.may_operate(F.col("signer"), F.col("operator"), F.col("agent"), F.col("until"), F.col("time"))
    repo = F.trim(F.coalesce("repo", F.lit("")))
    o = o.withColumn("_why", F.when(~acts, "not the operator").when(
        F.col("kind").isin("block", "unblock"), F.when(~P.is_hash(key("hash")), "invalid hash")
    ).when(F.col("kind") == "gate", F.when(~P.is_hash(key("root")), "invalid root").when((repo != "") & ~P.is_repo(repo), "invalid gate")
    ).when(F.col("kind") == "anchors", F.when(F.size("addrs") > MAX_ANCHORS, "too many anchors").when(F.exists("addrs", lambda a: ~a.rlike("/p2p/[A-Za-z0-9]+$")), "invalid anchor")))
    both = d.select(*c.columns, "_why").unionByName(o.select(*c.columns, "_why"))
    # only accepted statements are remembered, and a remembered one is refused when it comes again
    before = Window.partitionBy("registry", "sig").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("_why").isNull()).over(before), F.lit(False))
    return both.withColumn("refused", F.when(known, "repeated").otherwise(F.coalesce("_why", F.lit("")))).drop("_why")


def _org_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ownership of orgs: rows sorted by registry, org and seq stream through; held are one org's owners and accepted signatures."""
    at, own, seen = None, set(), set()
    for b in batches:
        out = []
        for registry, org, kind, signer, member, sig, why in zip(*(b.column(x).to_pylist() for x in ("registry", "org", "kind", "signer", "key", "sig", "_why"))):
            if (registry, org) != at:
                at, own, seen = (registry, org), set(), set()
            if sig in seen:
                why = "repeated"
            elif why is None and kind == "publish":
                if own and signer not in own:
                    why = "not an owner"
                elif not own:
                    own.add(signer)
            elif why is None:
                if not own:
                    why = "no such org"
                elif signer not in own:
                    why = "not an owner"
                elif kind == "grant":
                    why = "owns it already" if member in own else None
                    own.add(member)
                elif member not in own:
                    why = "no owner"
                elif len(own) == 1:
                    why = "last owner"
                else:
                    own.discard(member)
            if why is None:
                seen.add(sig)
            out.append(why or "")
        yield pa.RecordBatch.from_arrays([b.column("registry"), b.column("seq"), b.column("kind"), pa.array(out, pa.string())], ["registry", "seq", "kind", "refused"])


def validate(c: DataFrame, operators: DataFrame) -> DataFrame:
    """registry, seq, kind, refused (empty when accepted) of every statement of the chains (claims with repeated ones).

    Publishers must own the org (the first one founds it), grants and revokes come from owners, the last owner stays, what is blocked isn't
    published, blocklist, gates and anchors are the operator's (operators: registry, key) or its delegate's, names, keys, hashes and sizes must
    be valid, and no accepted statement counts twice (a signature names one statement). A statement of another kind, or one in a registry
    without operator that only one may make, is refused.

    Statements of the operator are judged by joins; those of orgs stream through in order, org by org, so what is held at once is the owners
    and signatures of one org."""
    c = written(c.join(operators.select("registry", F.col("key").alias("operator")), "registry", "left"), "statements")
    ops = written(_operator_statements(c), "operator")
    marks = ops.filter("refused = '' and kind in ('block', 'unblock')").select("registry", key("hash").alias("_root"), "seq", (F.col("kind") == "block").alias("on"))
    p = c.filter("kind in ('publish', 'grant', 'revoke')").withColumn("_root", F.when(F.col("kind") == "publish", key("root")))
    # only roots that were ever blocked are looked at in order
    ever = marks.select("registry", "_root").distinct()
    some = p.join(ever, ["registry", "_root"], "left_semi").select("registry", "_root", "seq", F.lit(None).cast("boolean").alias("on"))
    w = Window.partitionBy("registry", "_root").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bad = marks.unionByName(some).withColumn("was", F.last("on", ignorenulls=True).over(w)).filter("on is null and was").select("registry", "seq", F.lit(True).alias("_bad"))
    p = p.join(bad, ["registry", "seq"], "left").withColumn("_why", F.coalesce(_unfit(), F.when(F.col("_bad"), "blocked")))
    org = F.when(F.col("kind") == "publish", F.substring_index("name", "/", 1)).otherwise(F.col("org"))
    p = p.select("registry", org.alias("org"), "seq", "kind", "signer", "key", "sig", "_why").repartition("registry", "org").sortWithinPartitions("registry", "org", "seq")
    owned = p.mapInArrow(_org_rules, schema="registry string, seq long, kind string, refused string")
    known = ("publish", "grant", "revoke", "delegate", "block", "unblock", "gate", "anchors")
    other = c.filter(~F.coalesce(F.col("kind").isin(*known), F.lit(False))).select("registry", "seq", "kind", F.lit("unknown kind").alias("refused"))
    return owned.unionByName(ops.select("registry", "seq", "kind", "refused")).unionByName(other)


def publish(statements: DataFrame, manifests: DataFrame, blocklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused publishes: the manifest must be there, its root not blocked, its files safe and its root a hash."""
    s = statements.join(manifests.select(key("root").alias("root"), "files").dropDuplicates(["root"]), "root", "left")
    s = s.join(blocklist.select(F.col("hash").alias("root"), F.lit(True).alias("_blocked")).distinct(), "root", "left")
    why = (
        F.when(~P.is_hash(F.col("root")), "invalid root").when(F.col("files").isNull(), "no manifest").when(F.col("_blocked"), "blocked")
        .when(P.first_unsafe(F.col("files")).isNotNull(), F.concat(F.lit("unsafe: "), P.first_unsafe(F.col("files"))))
        .when(~P.is_name(F.col("name")) | ~P.is_rev(F.col("rev")), "invalid name")
    )
    s = s.withColumn("refused", why).drop("files", "_blocked")
    return s.filter("refused is null").drop("refused"), s.filter("refused is not null")

