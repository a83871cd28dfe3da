"""Operational roll-ups and state changes: status counts, alerts, retention, transitions, queues, limits.

Times are compared with an explicit ``as_of``, so that a run can be repeated.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import keep, release

# Allowed changes of state, and days that rows are kept.
DOCUMENT_STATES = (("draft", "review"), ("review", "approved"), ("review", "rejected"), ("rejected", "review"), ("approved", "published"))
TICKET_STATES = (("pending", "processing"), ("processing", "resolved"), ("resolved", "closed"))
CONVERSATION_STATES = (("ai", "waiting"), ("waiting", "human"), ("human", "closed"), ("ai", "closed"), ("waiting", "closed"))
RETENTION_DAYS = {"conversation": 365, "retrieval": 180, "feedback": 365, "audit": 730, "memory": 365, "ticket": 730}
SLA_MINUTES, WAITING_ALERT, FAITHFULNESS_ALERT, SATISFACTION_ALERT, LEAST_SAMPLE = 10, 20, 7.0, 0.8, 10


def rows(spark: SparkSession, values: Iterable[tuple], *names: str) -> DataFrame:
    """A small inline relation."""
    return spark.createDataFrame(list(values), list(names))


def status_counts(df: DataFrame, statuses: Iterable[str], breach: Column | None = None) -> DataFrame:
    """One row: a count per status, zero where there is none, the total, and the rows in breach."""
    out = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    return df.agg(*out, F.count("*").alias("total"), *([F.count_if(breach).alias("breaches")] if breach is not None else []))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A rounded share, zero of nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def feedback_stats(df: DataFrame, rating: Column) -> DataFrame:
    up = F.count_if(rating == 1)
    return df.agg(F.count("*").alias("total"), up.alias("positive"), F.count_if(rating == 0).alias("negative"), rate(up, F.count("*")).alias("satisfaction"))


def rag_stats(log: DataFrame, by: str, score: Column, escalated: Column) -> DataFrame:
    """By a key: the mean score without nulls to two decimals, the share of escalations to four, and the rows."""
    mean = F.round(F.avg(score.cast("decimal(20,6)")).cast("double"), 2)
    return log.groupBy(by).agg(F.coalesce(mean, F.lit(0.0)).alias("avg_value"), F.round(F.avg(escalated.cast("double")), 4).alias("escalate_rate"), F.count("*").alias("n"))


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], floor: bool = True, few: int = 100_000) -> DataFrame:
    """(by, n, one column for each name in ``wanted``): exact percentiles of each group by rank, without a group in one place.

    The value at index floor(p * n) of the n sorted ones, the last at most; with ``floor`` off, the least value that p * n
    values do not exceed (index ceil(p * n) - 1). Ranks are found by histograms: of the interval that holds a rank, bins
    are counted with their least and greatest values, and the bin with the rank is the next interval, until it holds
    one value or at most ``few`` rows, which are ranked. Counts are summed within tasks first, so a hot group is a few
    thousand rows to shuffle. Values that are null or no finite number take no part; a null group is a group.
    """
    bins = 1024
    base = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    stats = base.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    targets = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in wanted.items()])
    rank = F.floor(F.col("n") * F.col("p")) if floor else F.ceil(F.col("n") * F.col("p")) - 1
    state = stats.select(*by, "n", "lo", "hi", F.inline(targets)).withColumn("rank", F.greatest(F.lit(0), F.least(F.col("n") - 1, rank)).cast("long"))
    state = keep(state.withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n")), "ranks")
    many = state.count() > 100_000
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]

    def within(some: DataFrame) -> DataFrame:
        """The rows of the intervals of ``some``."""
        met = base.alias("b").join((some if many else F.broadcast(some)).alias("s"), functools.reduce(lambda x, y: x & y, [*same, F.col("_v") >= F.col("lo"), F.col("_v") <= F.col("hi")]))
        return met.select("s.*", "_v")

    settled = (F.col("lo") == F.col("hi")) | (F.col("inside") <= few)
    # bins of equal ratios and of equal widths in turn: the first part what lies far apart, the second what lies close by; halves, so that no width overflows
    scales = itertools.cycle([lambda v: F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1075)), lambda v: v / 2])
    while state.filter(~settled).limit(1).count():
        scale = next(scales)
        low, high = scale(F.col("lo")), scale(F.col("hi"))
        place = F.coalesce(F.floor(F.try_divide(scale(F.col("_v")) - low, high - low) * bins), F.lit(0))
        own = [*by, "n", "name", "p", "rank", "below"]
        counted = within(state.filter(~settled)).groupBy(*own, F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("inside").over(Window.partitionBy(*by, "name").orderBy("bin")) - F.col("inside") + F.col("below")
        met = counted.withColumn("below", before).filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside")))
        old, state = state, keep(state.filter(settled).unionByName(met.select(*state.columns)), "ranks")
        release(old)
    one = state.filter("lo = hi").select(*by, "n", "name", F.col("lo").alias("_v"))
    at = F.row_number().over(Window.partitionBy(*by, "name").orderBy("_v")) - 1
    few_left = within(state.filter("lo < hi")).withColumn("_at", at).filter(F.col("_at") == F.col("rank") - F.col("below")).select(*by, "n", "name", "_v")
    columns = [F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in wanted]
    return one.unionByName(few_left).groupBy(*by, "n").agg(*columns)


def last_of_each(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def least_loaded(agents: DataFrame, busy: DataFrame) -> DataFrame:
    """The available agent of each group with the fewest open conversations, the first in order of equals."""
    load = busy.groupBy("agent").agg(F.count("*").alias("load"))
    free = agents.filter("available").join(load, "agent", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    return free.groupBy("grp").agg(F.min_by("agent", F.struct("load", "ord")).alias("agent"), F.min("load").alias("load"))


def numbered(df: DataFrame, day: Column, order: str, prefix: str = "T", width: int = 3) -> DataFrame:
    """A ticket number per row: the day and its running number."""
    w = Window.partitionBy("_day").orderBy(order)
    n = F.row_number().over(w)
    padded = F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))
    return df.withColumn("_day", F.date_format(day, "yyyyMMdd")).withColumn("number", F.concat(F.lit(prefix), F.col("_day"), F.lit("-"), padded)).drop("_day")


def alerts_after(stored: DataFrame, emitted: DataFrame) -> DataFrame:
    """Alerts (key, severity, status) after new ones came in: a resolved one opens again, others keep their state."""
    s, e = stored.alias("s"), emitted.alias("e")
    status = F.when(F.col("s.key").isNull(), "open").when(F.col("e.key").isNotNull() & (F.col("s.status") == "resolved"), "open").otherwise(F.col("s.status"))
    return s.join(e, F.col("s.key") == F.col("e.key"), "full").select(F.coalesce("s.key", "e.key").alias("key"), F.coalesce("e.severity", "s.severity").alias("severity"), status.alias("status"))


def resolved_missing(stored: DataFrame, prefix: str, active: DataFrame) -> DataFrame:
    """Alerts of a prefix that are no longer active become resolved."""
    live = active.select("key").distinct().withColumn("_live", F.lit(True))
    gone = F.col("key").startswith(prefix) & F.col("_live").isNull()
    return stored.join(live, "key", "left").withColumn("status", F.when(gone, "resolved").otherwise(F.col("status"))).drop("_live")


def acknowledged(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Alerts (id, status, acknowledged_by) after people (id, actor) took some: those become acknowledged, whatever their state."""
    mine = asked.groupBy("id").agg(F.max("actor").alias("_actor"))
    both = stored.join(mine, "id", "left")
    taken = F.col("_actor").isNotNull()
    return both.withColumn("status", F.when(taken, "acknowledged").otherwise(F.col("status"))).withColumn("acknowledged_by", F.coalesce("_actor", "acknowledged_by")).drop("_actor")


def alert_page(alerts: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest alerts, of one state if it is given."""
    return (alerts.filter(F.col("status") == status) if status else alerts).orderBy(F.desc("id")).limit(limit)


def scanned_alerts(stats: DataFrame) -> DataFrame:
    """Operational alerts from one row of figures: breaches, overdue, waiting, faithfulness (n), satisfaction (n)."""
    rules = (
        ("sla", "high", F.col("breaches") > 0),
        ("overdue", "medium", F.col("overdue") > 0),
        ("queue", "high", F.col("waiting") >= WAITING_ALERT),
        ("faithfulness", "high", (F.col("faithfulness_n") >= LEAST_SAMPLE) & (F.col("faithfulness") < FAITHFULNESS_ALERT)),
        ("satisfaction", "medium", (F.col("feedback_n") >= LEAST_SAMPLE) & (F.col("satisfaction") < SATISFACTION_ALERT)),
    )
    on = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("key"), F.lit(sev).alias("severity"))) for k, sev, test in rules]))
    return stats.select(F.explode(on).alias("a")).select("a.*", F.lit("open").alias("status"))


def transitions(changes: DataFrame, allowed: Iterable[tuple[str, str]]) -> DataFrame:
    """Each change (from_state, to_state) with whether a table of moves allows it."""
    some = F.lit(False)
    for a, b in allowed:
        some = some | ((F.col("from_state") == a) & (F.col("to_state") == b))
    return changes.withColumn("legal", F.coalesce(some, F.lit(False)))


def kept(df: DataFrame, at: str, days: int, as_of: str, only: Column | None = None) -> DataFrame:
    """The rows that retention leaves; ``only`` says which rows may be deleted at all."""
    old = F.coalesce(F.col(at) < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.filter(~(old & only) if only is not None else ~old)


def cascaded(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def overdue(status: Column, due: Column, as_of: str) -> Column:
    return ~status.isin("resolved", "closed") & F.coalesce(due < F.to_timestamp(F.lit(as_of)), F.lit(False))


def breached(waiting: Column, answered: Column, since: Column, as_of: str, minutes: int = SLA_MINUTES) -> Column:
    """Whether a conversation still waits for its first answer after its time is up."""
    due = since + F.make_dt_interval(mins=F.lit(minutes))
    return waiting & ~F.coalesce(answered, F.lit(False)) & F.coalesce(due < F.to_timestamp(F.lit(as_of)), F.lit(False))


def present(users: DataFrame, presence: DataFrame, group: str) -> DataFrame:
    """Users of a group with their presence rows."""
    return users.filter(F.col("grp") == group).join(presence, "user_id")


def latest_states(checkpoints: DataFrame) -> DataFrame:
    """The state that each thread goes on from: its last checkpoint (thread, step, state)."""
    return checkpoints.groupBy("thread").agg(F.max("step").alias("step"), F.max_by("state", "step").alias("state"))


def admitted_at_most(events: DataFrame, seconds: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """Events with how many of their key came within ``seconds`` before, themselves included: a bound on what a limit admits."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w))


def history(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation in order, an agent's as the assistant's."""
    role = F.when(F.col("role") == "agent", "assistant").otherwise(F.col("role"))
    return last_of_each(turns, key, order, n).withColumn("role", role)


def readable(df: DataFrame, grants: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Rows of knowledge bases that a user was granted; an administrator reads all."""
    return df if admin else df.join(grants.filter(F.col("user_id") == user).select("kb_id").distinct(), "kb_id", "left_semi")


def upserted(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``new`` in place of the stored rows of the same key."""
    return stored.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def stale(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Stored rows that a new version of their document no longer has."""
    return stored.join(new.select(*key), list(key), "left_anti")


def snapshot(chunks: DataFrame, doc: str = "doc", at: str = "chunk_index") -> DataFrame:
    """A row per document with its chunks in order."""
    return chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(at, "chunk", "text"))).alias("chunks"))


def restored(snapshots: DataFrame, doc: str = "doc") -> DataFrame:
    return snapshots.select(doc, F.inline("chunks"))


def versioned(versions: DataFrame, doc: str = "doc_id", order: str = "created_at") -> DataFrame:
    """Version numbers from 1, in order, per document."""
    return versions.withColumn("version_no", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def rolled_back(versions: DataFrame, doc: str, to: int) -> DataFrame:
    """The versions of all documents with one more of ``doc``: the snapshot of an old version under the next number."""
    own = versions.filter(F.col("doc_id") == doc)
    last = own.agg(F.max("version_no").alias("_last"))
    again = own.filter(F.col("version_no") == to).join(F.broadcast(last), how="cross").withColumn("version_no", F.col("_last") + 1)
    return versions.unionByName(again.select(*versions.columns))


def leased(sources: DataFrame, as_of: str, minutes: int, most: int) -> DataFrame:
    """Sources that are due and free, the longest due first, with a new lease."""
    now = F.to_timestamp(F.lit(as_of))
    due = sources.filter(F.col("enabled") & (F.col("next_sync_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") < now)))
    return due.orderBy("next_sync_at", "id").limit(most).withColumn("lease_until", now + F.make_dt_interval(mins=F.lit(minutes)))


def _let_in(times: list[int], seen: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Whether each of a key's times in order is let in, and the last times let in. A ring of ``limit`` times: the oldest one decides."""
    ring, out = list(seen[-limit:]), []
    at = 0 if len(ring) == limit else len(ring)
    for t in times:
        ok = limit > 0 and (len(ring) < limit or ring[at] <= t - window)
        if ok:
            if len(ring) < limit:
                ring.append(t)
            else:
                ring[at] = t
            at = (at + 1) % limit
        out.append(ok)
    return out, (ring[at:] + ring[:at]) if len(ring) == limit else ring


def _streaks(pdf: pd.DataFrame, key: str, window: int) -> np.ndarray:
    """Where, in a part's ordered rows, a key begins or a gap of the window's length has passed: what was let in before has no say there."""
    new = np.ones(len(pdf), bool)
    k, t = pdf[key].to_numpy(), pdf["_at"].to_numpy()
    same = (k[1:] == k[:-1]) | (pd.isna(k[1:]) & pd.isna(k[:-1]))
    new[1:] = ~same | (t[1:] - t[:-1] >= window)
    return np.flatnonzero(new)


def admitted(events: DataFrame, limit: int, seconds: int, key: str = "user_id", at: str = "ts", order: str = "event_id", part_rows: int = 200_000) -> DataFrame:
    """Events with whether a sliding window lets them in: fewer than ``limit`` were let in within ``seconds`` before.

    Only admitted events count, so each depends on earlier decisions of its key. Events are dealt to parts of about
    ``part_rows`` by ranges of key and time, so a key with a third of all events is many parts. Where a gap of the
    window's length has passed, nothing earlier counts, so a part decides all from its first gap on by itself; its head
    waits for the last times that the part before let in. One row a part goes to the driver, which hands these times on;
    only where a part has no gap at all does the next one wait for it. Events of equal time go by ``order``; a null key
    is a key; events without a time are not let in and do not count.
    """
    window = seconds * 1_000_000
    columns = list(events.columns)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = events.filter(F.col(at).isNotNull()).withColumn("_at", micros)
    n = max(1, -(-timed.count() // part_rows))
    sort = [key, "_at", order]
    parts = keep(timed.repartitionByRange(n, *sort).withColumn("_part", F.spark_partition_id()), "parts")
    schema = T.StructType([*(events.schema[c] for c in columns), T.StructField("admitted", T.BooleanType())])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part's first and last event, and the times let in at its end, null where they depend on what came before."""
        pdf = pdf.sort_values(sort, na_position="first", kind="stable")
        cuts = _streaks(pdf, key, window)
        end = None if len(cuts) == 1 else _let_in(pdf["_at"].tolist()[cuts[-1] :], [], limit, window)[1]
        k = pdf[key].iloc[[0, -1]]
        return pd.DataFrame({"_part": [pdf["_part"].iloc[0]], "first_key": k.astype(object).where(k.notna(), None).iloc[0], "last_key": k.astype(object).where(k.notna(), None).iloc[1], "first_at": [pdf["_at"].iloc[0]], "last_at": [pdf["_at"].iloc[-1]], "end": [end]})

    def handed_on(known: dict[int, list[int]]):
        def end(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(sort, na_position="first", kind="stable")
            part = int(pdf["_part"].iloc[0])
            return pd.DataFrame({"_part": [part], "end": [_let_in(pdf["_at"].tolist(), known[part], limit, window)[1]]})

        return end

    kind = events.schema[key].dataType.simpleString()
    shape = f"_part int, first_key {kind}, last_key {kind}, first_at long, last_at long, `end` array<long>"
    rows = sorted(parts.select(key, "_at", order, "_part").groupBy("_part").applyInPandas(summary, shape).collect(), key=lambda r: r["_part"])
    given, ends, waiting = {}, {}, []
    for before, r in zip([None, *rows], rows):
        free = before is None or before["last_key"] != r["first_key"] or r["first_at"] - before["last_at"] >= window
        given[r["_part"]] = [] if free else None
        ends[r["_part"]] = list(r["end"]) if r["end"] is not None else None
        if not free or ends[r["_part"]] is None:
            waiting.append((before["_part"] if before is not None and not free else None, r["_part"]))
    while waiting:
        # times are handed on as far as they are known; then parts without a gap that now know theirs are decided, all at once
        for before, part in waiting:
            if given[part] is None and ends[before] is not None:
                given[part] = ends[before]
        ready = {part: given[part] for _, part in waiting if given[part] is not None and ends[part] is None}
        if ready:
            done = parts.filter(F.col("_part").isin(list(ready))).select(key, "_at", order, "_part").groupBy("_part")

            ends |= {r["_part"]: list(r["end"]) for r in done.applyInPandas(handed_on(ready), "_part int, `end` array<long>").collect()}
        waiting = [(b, p) for b, p in waiting if given[p] is None or ends[p] is None]

    heads = {p: seen for p, seen in given.items() if seen}

    def decided(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, na_position="first", kind="stable")
        times, flags = pdf["_at"].tolist(), []
        cuts = [*_streaks(pdf, key, window).tolist(), len(pdf)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            flags += _let_in(times[lo:hi], heads.get(int(pdf["_part"].iloc[0]), []) if not i else [], limit, window)[0]
        return pdf[columns].assign(admitted=pd.Series(flags, index=pdf.index, dtype=bool))

    out = parts.groupBy("_part").applyInPandas(decided, schema)
    return out.unionByName(events.filter(F.col(at).isNull()).withColumn("admitted", F.lit(False)))


def ingest_plan(local: DataFrame, state: DataFrame) -> DataFrame:
    """What to do with each file (kb_id, path, sha256, error): fail, skip, update or new, by the last known state."""
    both = local.join(state.select("kb_id", "path", F.col("sha256").alias("known")), ["kb_id", "path"], "left")
    plan = F.when(F.col("error").isNotNull(), "FAIL").when(F.col("known").isNull(), "NEW").when(F.col("known") == F.col("sha256"), "SKIP").otherwise("UPDATE")
    return both.select("kb_id", "path", plan.alias("plan"))


def reconciled(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a manifest (path, size, sha256) against what is there: ok, missing, extra, size or hash."""
    m, f = manifest.alias("m"), files.alias("f")
    said = F.when(F.col("f.path").isNull(), "missing").when(F.col("m.path").isNull(), "extra").when(F.col("m.size") != F.col("f.size"), "size").when(F.col("m.sha256") != F.col("f.sha256"), "hash").otherwise("ok")
    return m.join(f, F.col("m.path") == F.col("f.path"), "full").select(F.coalesce("m.path", "f.path").alias("path"), said.alias("finding"))


def first_of_each_hash(df: DataFrame, text: str, key: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each content hash within a key. Only hashes and orders are shuffled, not texts."""
    hashed = df.select(*key, order, F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy(*key, "content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def unread(messages: DataFrame) -> DataFrame:
    """(conv_id, unread, first_response): user messages behind the last of an agent, and the agent's first."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    sums = messages.groupBy("conv_id").agg(last.alias("last"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_response"))
    behind = messages.join(sums, "conv_id").groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & (F.col("turn") > F.coalesce("last", F.lit(-1)))).alias("unread"), F.first("first_response").alias("first_response"))
    return behind


def agent_queue(waiting: DataFrame, human: DataFrame, agent: str, kbs: list[str], everyone: bool = False, text: str = "") -> DataFrame:
    """Waiting conversations and an agent's own (or all) of some knowledge bases that hold a text, unread first, then the newest."""
    own = human if everyone else human.filter(F.col("agent") == agent)
    both = waiting.unionByName(own).filter(F.col("kb_id").isin(kbs))
    held = F.lit(False)
    for c in ("title", "customer", "last_text"):
        held = held | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return (both.filter(held) if text else both).orderBy(F.desc("unread"), F.desc("updated_at"))


def remembered(memory: DataFrame, new: DataFrame, consent: DataFrame, as_of: str) -> DataFrame:
    """Memories (owner, key, value, expires_at) after new ones: only of owners who consent, none that has expired."""
    live = upserted(memory, new, ("owner", "key")).filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.to_timestamp(F.lit(as_of))))
    return live.join(consent.filter("enabled").select("owner"), "owner", "left_semi")


def authenticated(tokens: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """(token, user_id, role) of tokens whose hash a user has and that have not expired."""
    hashed = tokens.select("token", F.sha2(F.col("token").cast("binary"), 256).alias("token_hash"))
    good = users.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.to_timestamp(F.lit(as_of))))
    return hashed.join(good, "token_hash").select("token", "user_id", "role")


def dashboard(**rows: DataFrame) -> DataFrame:
    """One row of several one-row aggregates, each a struct."""
    out = None
    for name, df in rows.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one), how="cross")
    return out


def changed_sources(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, sha256, state): new, unchanged or changed by the last known hash."""
    both = sources.join(contents.select("id", F.sha2("content", 256).alias("sha256")), "id")
    state = F.when(F.col("last_hash").isNull(), "new").when(F.col("last_hash") == F.col("sha256"), "unchanged").otherwise("changed")
    return both.select("id", "sha256", state.alias("state"))
