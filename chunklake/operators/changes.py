"""Change feeds: the longest hash chain of a log, and ordered replay of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunklake.common import key, written

GENESIS = "0" * 64
FANOUT = 8192

_LINK = "log string, pos long, came string, went string, tail long, tip string, whole boolean, pick boolean"


def _paths(rows: list[dict]) -> tuple[list[tuple[dict, str, dict | None]], dict]:
    """Each row with the `came` of the first position it leads back to, and the row before it. rows: one block."""
    first = min(r["pos"] for r in rows)
    back: dict[tuple[int, str], tuple[str, dict]] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["pos"], not r["whole"], r["tip"] or "", r["came"] or "")):
        if r["pos"] == first:
            root, before = r["came"], None
        else:
            got = back.get((r["pos"], r["came"]))
            if got is None:
                continue
            root, before = got
        out.append((r, root, before))
        if r["whole"]:
            back.setdefault((r["pos"] + 1, r["went"]), (root, r))
    return out, back


def _better(a: dict, b: dict | None) -> bool:
    return b is None or (a["tail"], b["tip"] or "") > (b["tail"], a["tip"] or "")


def _block_links(span: int):
    """Of one block of positions: one link per whole path through it, and per start the path that reaches furthest."""

    def block(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        log, number = rows[0]["log"], rows[0]["block"]
        out = []
        if any(r["pos"] == number * span for r in rows):
            paths, _ = _paths(rows)
            far: dict[str, dict] = {}
            for r, root, _ in paths:
                if _better(r, far.get(root)):
                    far[root] = r
                if r["whole"] and r["pos"] == number * span + span - 1:
                    out.append((log, number, root, r["went"], r["tail"], r["tip"], True, False))
            out += [(log, number, root, None, r["tail"], r["tip"], False, False) for root, r in far.items()]
        return pa.table(dict(zip(("log", "pos", "came", "went", "tail", "tip", "whole", "pick"), map(list, zip(*out)) if out else [[]] * 8)), schema=_ARROW)

    return block


_ARROW = pa.schema([("log", pa.string()), ("pos", pa.int64()), ("came", pa.string()), ("went", pa.string()), ("tail", pa.int64()), ("tip", pa.string()), ("whole", pa.bool_()), ("pick", pa.bool_())])


def _block_picks(t: pa.Table) -> pa.Table:
    """Of one block, the rows on the path that its picked link stands for."""
    rows = t.to_pylist()
    links = [r for r in rows if not r["pick"]]
    keep: list[dict] = []
    for p in (r for r in rows if r["pick"]):
        paths, _ = _paths(links)
        before = {id(r): b for r, _, b in paths}
        at = next((r for r, root, _ in paths if root == p["came"] and r["tip"] == p["tip"] and r["tail"] == p["tail"] and r["whole"] >= p["whole"]), None)
        at = at or next((r for r, root, _ in paths if root == p["came"] and r["tip"] == p["tip"] and r["tail"] == p["tail"]), None)
        while at is not None:
            keep.append(at)
            at = before[id(at)]
    return pa.table({c: [True if c == "pick" else r[c] for r in keep] for c in _ARROW.names}, schema=_ARROW)


def _plausible(base: DataFrame) -> DataFrame:
    """Entries that can be on a longest chain (log, seq, prev, own, followed): those whose predecessor is there. Of several that follow the same
    one, those that nothing follows can't be on it if something follows another, and else only that with the smallest hash can. So no flood
    of forged entries at one position gathers in a block."""
    # one shuffle by (log, seq, own) tells of each entry whether it has a predecessor and a follower
    me = base.select("log", "seq", "own", "prev", F.lit(1).alias("k"))
    child = base.select("log", (F.col("seq") - 1).alias("seq"), F.col("prev").alias("own"), F.lit(None).cast("string").alias("prev"), F.lit(2).alias("k")).distinct()
    parent = base.select("log", (F.col("seq") + 1).alias("seq"), F.col("own").alias("prev"), F.lit(True).alias("_known"))
    w = Window.partitionBy("log", "seq", "own")
    e = me.unionByName(child).withColumn("followed", F.max(F.col("k") == 2).over(w)).filter("k = 1").drop("k")
    e = e.join(parent, ["log", "seq", "prev"], "left").filter("_known or seq = 0").drop("_known")
    same = e.groupBy("log", "seq", "prev").agg(F.max("followed").alias("_any"), F.min("own").alias("own"))
    ends = same.filter("not _any").select("log", "seq", "prev", "own", F.lit(False).alias("followed"))
    return e.filter("followed").select("log", "seq", "prev", "own", "followed").unionByName(ends)


def longest_chain(entries: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The (log, seq, own) of the longest chain of each log from seq 0 on.

    entries: log, seq, prev, own (the entry's own hash); an entry follows the one of seq-1 whose own is its prev, and
    seq 0 follows 64 zeros. Positions are cut into blocks of `fanout`; each block is reduced to the paths through
    it, these again, until one block is left; then the best path is traced back down. So no task ever holds more than one
    block. Equal lengths: the chain with the smallest last hash. Entries with null fields are on no chain; repeated ones count once."""
    base = entries.select("log", "seq", "prev", "own").filter("log is not null and seq >= 0 and prev is not null and own is not null").distinct()
    # hashed and made distinct once, and linked once: both are read several times
    base = written(base.filter((F.col("seq") > 0) | (F.col("prev") == GENESIS)), "entries")
    linked = written(_plausible(base), "linked")
    n = linked.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d")).agg(F.max("n").alias("most"), F.bool_or(F.col("n") > F.col("d")).alias("forked")).first()
    if not n["forked"]:
        # no fork is left: each entry follows the one before it, so a log's chain ends where the first of them has no follower
        end = linked.filter("not followed").groupBy("log").agg(F.min("seq").alias("_end"))
        start = linked.filter("seq = 0").select("log")
        return linked.join(end, "log").join(start, "log", "left_semi").filter(F.col("seq") <= F.col("_end")).select("log", "seq", "own")
    # a chain of n entries ends at seq n-1, so seqs beyond a log's count can't be on it
    bound = n["most"]
    base = linked.filter(F.col("seq") < bound)
    levels = [
        base.select("log", F.col("seq").alias("pos"), F.col("prev").alias("came"), F.col("own").alias("went"), F.col("seq").alias("tail"), F.col("own").alias("tip"), F.lit(True).alias("whole"), F.lit(False).alias("pick"))
    ]
    width = bound
    while width > 1:
        up = levels[-1].withColumn("block", F.expr(f"pos div {fanout}")).groupBy("log", "block").applyInArrow(_block_links(fanout), schema=_LINK)
        width = -(-width // fanout)
        levels.append(written(up, "links") if width > 1 else up)
    w = Window.partitionBy("log").orderBy(F.desc("tail"), "tip", F.desc("whole"))
    picked = levels[-1].filter(F.col("came") == GENESIS).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").withColumn("pick", F.lit(True))
    for below in reversed(levels[:-1]):
        # a block has at most one picked link, but for a block whose path is whole there may be a second one that stops in it
        up = picked.select("log", F.col("pos").alias("block"), "pos", "came", "went", "tail", "tip", "whole", "pick")
        mine = below.withColumn("block", F.expr(f"pos div {fanout}")).join(up.select("log", "block").distinct(), ["log", "block"], "left_semi")
        both = mine.select(up.columns).unionByName(up)
        picked = both.groupBy("log", "block").applyInArrow(_block_picks, schema=_LINK)
    return picked.select("log", F.col("pos").alias("seq"), F.col("went").alias("own")).distinct()


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], cols: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (and sequence), each a piece of a key's state, folded to one row per run of a key."""
    state: dict | None = None
    done: list[dict] = []

    def fold(s: dict, r: dict) -> None:
        for f in ("_put", "_cut"):
            if r[f] is not None and (s[f] is None or r[f] > s[f]):
                s[f] = r[f]
        for c in cols:
            q = r[f"_at_{c}"]
            at = s[f"_at_{c}"]
            # an already applied sequence changes nothing; of two values of one sequence the larger stays
            if q is not None and (at is None or q > at or q == at and r[c] > s[c]):
                s[f"_at_{c}"], s[c] = q, r[c]

    for b in batches:
        for r in b.to_pylist():
            if state is not None and all(state[k] == r[k] for k in keys):
                fold(state, r)
            else:
                if state is not None:
                    done.append(state)
                state = r
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if state is not None:
        done.append(state)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def replay(changes: DataFrame, keys: list[str], seq: str, op: str, cols: list[str]) -> DataFrame:
    """The current rows (keys, cols) of a table after its change feed.

    op: `upsert` sets the columns that aren't null and leaves the others (an insert or a partial update), `delete`
    removes the row. Changes apply in the order of `seq` whatever their order in the feed; one with a sequence
    already applied to the key changes nothing, so feeds may repeat. Of two different changes with one sequence a delete
    counts last, then the larger values. Rows with a null seq or another op are no changes; null keys are keys like any other. An empty feed is an empty table.

    Each partition first replays its own part, sorted by key and sequence, into one piece of state per key (each column with the
    sequence that set it); only these pieces are shuffled and replayed per key. So a hot key costs one row per partition."""
    types = {f.name: f.dataType for f in changes.schema.fields}
    good = changes.filter(F.col(seq).isNotNull() & F.col(op).isin("upsert", "delete"))
    up = F.col(op) == "upsert"
    pieces = good.select(
        *keys, F.col(seq).cast("bigint").alias("_seq"),
        F.when(up, F.col(seq)).cast("bigint").alias("_put"), F.when(~up, F.col(seq)).cast("bigint").alias("_cut"),
        *[x for c in cols for x in (F.when(up, F.col(c)).alias(c), F.when(up & F.col(c).isNotNull(), F.col(seq)).cast("bigint").alias(f"_at_{c}"))],
    ).sortWithinPartitions(*keys, "_seq", *[F.desc_nulls_last(c) for c in cols]).drop("_seq")
    shape = T.StructType([T.StructField(c, types.get(c, T.LongType())) for c in pieces.columns])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)
    one = lambda it: _partial(it, keys, cols, arrow)
    part = pieces.mapInArrow(one, schema=shape)
    whole = part.repartition(*keys).sortWithinPartitions(*keys, F.coalesce("_put", "_cut")).mapInArrow(one, schema=shape)
    alive = whole.filter("_put is not null and (_cut is null or _put > _cut)")
    return alive.select(*keys, *[F.when(F.col("_cut").isNull() | (F.col(f"_at_{c}") > F.col("_cut")), F.col(c)).alias(c) for c in cols])


def registry_entries(log: DataFrame) -> DataFrame:
    """Entries of registry logs with the hash the next entry must name as prev; rows without a statement have none."""
    return log.select(
        F.col("registry").alias("log"), "seq", key("prev").alias("prev"), "statement",
        F.when(F.col("statement").isNotNull(), F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("prev"), F.col("statement.signature.sig")), 256)).alias("own"),
        "received",
    )


def registry_changes(log: DataFrame) -> DataFrame:
    """What the effective statements of each registry's log change: registry, item, item_key, member, seq, op, value."""
    e = registry_entries(log).filter("own is not null and statement.signature.sig is not null")
    on = longest_chain(e).select("log", "seq", "own")
    s = e.join(on, ["log", "seq", "own"], "left_semi")
    # one row per entry (it may have been received several times), then the first entry of each signature
    first = lambda by, o: F.row_number().over(Window.partitionBy(*by).orderBy(*o))
    s = s.withColumn("r", first(["log", "seq"], [F.col("received").asc_nulls_last()])).filter("r = 1")
    s = s.withColumn("r", first(["log", "statement.signature.sig"], ["seq"])).filter("r = 1")
    used = ["kind", "name", "rev", "root", "gated", "org", "key", "hash", "repo"]
    c = s.select("log", "seq", *[f"statement.claim.{x}" for x in used], F.col("statement.signature.key").alias("signer"))
    c = written(c, "claims")  # each kind of statement is read from it below
    org = F.substring_index("name", "/", 1)
    firsts = c.filter("kind = 'publish' and name is not null").groupBy("log", org.alias("org_of")).agg(F.min_by(F.struct("seq", "signer"), "seq").alias("f"))

    def rows(df: DataFrame, item: str, item_key, op, value, member=None) -> DataFrame:
        return df.select(
            F.col("log").alias("registry"), F.lit(item).alias("item"), item_key.alias("item_key"),
            (member if member is not None else F.lit("")).alias("member"), "seq", op.alias("op"), value.alias("value"),
        ).filter("item_key is not null and member is not null")

    up, cut, none = F.lit("upsert"), F.lit("delete"), F.lit("")
    pub = c.filter("kind = 'publish'")
    gates = c.filter("kind = 'gate'")
    lifted = F.coalesce(F.trim("repo"), none) == ""
    return (
        rows(pub, "name", F.concat("name", F.lit("@"), "rev"), up, key("root"))
        .unionByName(rows(pub.filter("gated is not null"), "gate", key("root"), F.when(F.col("gated") == "", cut).otherwise(up), F.col("gated")))
        .unionByName(rows(gates, "gate", key("root"), F.when(lifted, cut).otherwise(up), F.col("repo")))
        .unionByName(rows(firsts.select("log", "org_of", "f.seq", "f.signer"), "owner", F.col("org_of"), up, none, F.col("signer")))
        .unionByName(rows(c.filter("kind in ('grant', 'revoke')"), "owner", F.col("org"), F.when(F.col("kind") == "grant", up).otherwise(cut), none, F.col("key")))
        .unionByName(rows(c.filter("kind in ('block', 'unblock')"), "blocked", key("hash"), F.when(F.col("kind") == "block", up).otherwise(cut), none))
    )


def registry_state(log: DataFrame) -> DataFrame:
    """The items that stand at the end of each registry's log: registry, item, item_key, item_value."""
    state = replay(registry_changes(log), ["registry", "item", "item_key", "member"], "seq", "op", ["value"])
    return state.select("registry", "item", "item_key", F.when(F.col("item") == "owner", F.col("member")).otherwise(F.col("value")).alias("item_value"))
