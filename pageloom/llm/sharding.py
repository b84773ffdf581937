"""Sharding by balanced label propagation; DataFrame operations only.

Documents of equal text are linked. Linked documents start in a shard given by a hash; in every round each group looks
for the shard where most of its documents are and which isn't closed, and its documents elsewhere ask to move there.
Requests are granted by priority up to the target's quota, where what leaves a shard makes room, and in part if need
be, until nothing moves. Large groups settle before small ones, which start where room is left. Documents of one group in one shard are interchangeable, so
the state is a count for each (group, shard) - at most as many rows as shards for each group, however large it is.
Unlinked documents then fill every shard up to its exact share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import cut, discard, stored

SHARDS = 40
#: Rounds that move little or nothing, under other ties, after which propagation is over; little is a thousandth of the documents.
IDLE, LITTLE = 3, 1000
#: Rows that one window of the distributed ranking should hold.
RANK_ROWS = 50_000


def dealt_rank(df: DataFrame, by: list[str], spread: list[str], rows: int, name: str) -> DataFrame:
    """Adds a gapless rank from 0 in each group, without bringing a group together: ranks in hash buckets plus offsets."""
    buckets = max(64, rows // RANK_ROWS)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    keys = [*by, "_b"]
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*spread))
    return df.repartition(*keys).withColumn("_r", inside).join(starts, keys).withColumn(name, F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start")


def _pick(values: list[int], index: Column) -> Column:
    """values[index]; one value for each shard."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def _flows(wanted: dict[tuple[int, int], int], loads: list[int], quotas: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted documents go from shard to shard; what leaves a shard makes room in it.

    All requests are granted at first; then shards over their quota take less, until none is over by what it takes.
    """
    flow, pairs = dict(wanted), range(len(quotas))
    into = [[k for k in flow if k[1] == t] for t in pairs]
    load = [loads[t] + sum(flow[k] for k in into[t]) - sum(n for (s, _), n in flow.items() if s == t) for t in pairs]
    queue = [t for t in pairs if load[t] > quotas[t]]
    while queue:
        t = queue.pop()
        total = sum(flow[k] for k in into[t])
        over = min(load[t] - quotas[t], total)
        if over <= 0:
            continue
        less = {k: flow[k] * over // total for k in into[t]}
        rest = over - sum(less.values())
        for k in sorted(into[t], key=lambda k: less[k] - flow[k]):
            extra = min(rest, flow[k] - less[k], 1)
            less[k], rest = less[k] + extra, rest - extra
        for k, n in less.items():
            flow[k] -= n
            load[k[0]] += n
            if n and load[k[0]] > quotas[k[0]]:
                queue.append(k[0])
        load[t] -= over
    return {k: n for k, n in flow.items() if n}


def propagate(state: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """Rounds of label propagation over (g, shard, n) under a quota for each shard, until next to nothing moves any more.

    Every move goes to a place where the group has as many documents at least, so cut links get fewer in each round
    and the rounds come to an end. A shard that is full and lets nothing go is closed to requests; idle rounds, which
    move less than a share of 1 / LITTLE of the documents, are tried again with other ties before it is over. A round's
    state is written and read again: lineage, and what the optimizer takes the table to weigh, stay as they are.
    """
    shards = range(len(quotas))
    parts = max(1, -(-state.count() // RANK_ROWS))  # the state has far fewer rows than the documents; so have its tasks
    state = state.coalesce(parts)
    found = dict(state.groupBy("shard").agg(F.sum("n")).collect())  # one row for each shard
    loads = [found.get(t, 0) for t in shards]
    closed: set[int] = set()
    little, made = sum(loads) // LITTLE, []
    turn = idle = 0
    while idle < IDLE and (rounds is None or turn < rounds):
        of_use = [0 if t in closed else q for t, q in enumerate(quotas)]
        liked = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)).alias("tie"), "shard")
        best = state.where(F.col("n") < _pick(of_use, F.col("shard"))).groupBy("g").agg(F.max(liked).alias("to")).coalesce(parts)
        asks = state.join(best, "g").where("shard <> to.shard and n <= to.n").select("g", "shard", "n", F.col("to.shard").alias("to"), F.col("to.n").alias("m")).coalesce(parts)
        wanted = {(s, t): n for s, t, n in asks.groupBy("shard", "to").agg(F.sum("n")).collect()}  # one row for two shards
        flow = _flows(wanted, loads, quotas)
        turn += 1
        taking = {t for _, t in flow}
        full = {t for _, t in wanted if t not in taking}
        if flow:
            first = Window.partitionBy("shard", "to").orderBy(F.desc("m"), F.xxhash64("g"), "g").rowsBetween(Window.unboundedPreceding, -1)
            granted = state.sparkSession.createDataFrame([(s, t, n) for (s, t), n in flow.items()], "shard int, to int, most long")
            moves = asks.join(F.broadcast(granted), ["shard", "to"]).withColumn("moved", F.least("n", F.col("most") - F.coalesce(F.sum("n").over(first), F.lit(0))))
            moves = moves.where("moved > 0").select("g", "shard", "to", "moved").coalesce(parts)
            after = state.join(moves, ["g", "shard"], "left").select("g", F.explode(F.array(
                F.struct("shard", (F.col("n") - F.coalesce("moved", F.lit(0))).alias("n")), F.struct(F.col("to").alias("shard"), F.coalesce("moved", F.lit(0)).alias("n"))
            )).alias("x"))
            state = stored(after.select("g", "x.shard", "x.n").where("n > 0").coalesce(parts).groupBy("g", "shard").agg(F.sum("n").alias("n")).coalesce(parts), "shard-state", made).coalesce(parts)
            if len(made) > 1:
                discard(state.sparkSession, made.pop(0))
            for (s, t), n in flow.items():
                loads[s], loads[t] = loads[s] - n, loads[t] + n
            closed = {t for t in closed | full if loads[t] >= quotas[t]}
            idle = idle + 1 if sum(flow.values()) <= little else 0
        elif full <= closed:  # nothing moves, and nothing more is to be closed
            if not wanted and not closed:
                break
            closed, idle = set(), idle + 1
        else:
            closed |= full
    return state


def settle(state: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """Label propagation by classes of group size, the largest first; smaller groups begin where those leave room."""
    widest = max(1, max(quotas))
    size_class = F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(2.0 * widest) / F.col("total"))) / 2).cast("int")
    state = cut(state.withColumn("class", size_class))
    classes = sorted(r[0] for r in state.select("class").distinct().collect())  # log of the quota
    room, done = list(quotas), []
    for c in classes:
        part = state.where(F.col("class") == c).select("g", "shard", "n")
        if done:
            ends = [sum(room[: t + 1]) for t in range(len(room))]
            at = F.pmod(F.xxhash64("g", "shard"), F.lit(max(1, ends[-1])))
            part = part.withColumn("shard", F.least(F.lit(len(room) - 1), F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= at))))
            part = part.groupBy("g", "shard").agg(F.sum("n").alias("n"))
        part = propagate(cut(part), room, rounds)
        loads = dict(part.groupBy("shard").agg(F.sum("n")).collect())  # one row for each shard
        room = [max(0, q - loads.get(t, 0)) for t, q in enumerate(room)]
        done.append(part)
    out = state.select("g", "shard", "n").limit(0) if not done else done[0]
    for part in done[1:]:
        out = out.union(part)
    return cut(out)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; law ``rows``: counts at most one apart.

    Null texts have size 16 and the digest of no bytes, and are linked to nothing; empty texts are linked to each other.
    Repeated rows are linked copies with slots of their own. Other columns are ignored.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    base = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"), F.md5("text").alias("g"))
    base = cut(base)
    n = base.count()
    quotas = [(t + 1) * n // shards - t * n // shards for t in range(shards)]
    spread = ["doc_id", "crc"]

    first = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(shards)).cast("int")
    state = base.where("g is not null").groupBy("g", first.alias("shard")).agg(F.count("*").alias("n"))
    linked = state.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1")
    state = settle(state.join(linked, "g"), quotas, rounds)

    before = Window.partitionBy("g").orderBy(F.desc("n"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = state.withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most one row for each shard
    spans = cut(spans.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("lo", "shard"))).alias("spans")))
    copies = cut(base.join(spans.select("g"), "g", "left_semi").select(*base.columns))  # a join that stands alone: a hot text can be split
    grouped = dealt_rank(copies, ["g"], spread, n, "rk")
    placed = grouped.join(spans, "g").select(*base.columns, F.expr("element_at(filter(spans, x -> x.lo <= rk), -1).shard").alias("shard"))
    placed = cut(dealt_rank(placed, ["shard"], spread, n, "slot"))
    kept = placed.where(F.col("slot") < _pick(quotas, F.col("shard")))
    counts = dict(kept.groupBy("shard").agg(F.count("*")).collect())  # one row for each shard
    free = [q - counts.get(t, 0) for t, q in enumerate(quotas)]
    ends = [sum(free[: t + 1]) for t in range(shards)]

    spilled = placed.where(F.col("slot") >= _pick(quotas, F.col("shard"))).select(*base.columns)
    rest = base.join(spans.select("g"), "g", "left_anti").select(*base.columns).union(spilled)
    rest = dealt_rank(rest, [], spread, n, "r")
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("r")))
    rest = rest.withColumn("shard", shard)
    slot = _pick([counts.get(t, 0) - (ends[t] - free[t]) for t in range(shards)], F.col("shard")) + F.col("r")
    both = kept.select(*base.columns, "shard", "slot").union(rest.select(*base.columns, "shard", slot.alias("slot")))
    return both.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
