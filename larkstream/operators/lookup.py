"""Ranked lookups: the device that a query names.

The form of a query picks its rule, and that rule alone decides: an index or id that is not there is an
error, and later rules are not tried. Rules: 1 the default device, 2 a stable id, 3 a prefixed position,
4 a bare position, 5 the first device whose name contains the query in any case (an empty query is part
of every name). Results have one row per distinct query: query, pos, name, rule and error; where error
is set, pos and name are null.

A microphone is looked for among the devices that can record, and positions count those alone; only an id may
name another device, which is an error then. `pos` is the device's place in the list of all. Of devices
with one id or position the first counts.

Rules 1 to 4 are equality joins, rule 5 is `operators.names`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkstream.operators.names import first_with_part
from larkstream.operators.order import global_rank

#: What stable ids begin with.
ID = r"^(?:alsa|asio|coreaudio|id|jack|wasapi):.+$"
NUMBER = r"^\+?[0-9]+\z"


def _number(text: Column) -> Column:
    """A position: digits with an optional plus sign; leading zeros do not matter."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, r"^\+?0*(?=[0-9])", "").try_cast("bigint"))


def _listed(devices: DataFrame) -> DataFrame:
    """pos, id, name and input (whether it can record) of the devices."""
    one = lambda c, other: F.col(c) if c in devices.columns else other
    return devices.select(F.col("pos").cast("long").alias("_pos"), one("id", F.lit(None).cast("string")).alias("_id"), F.col("name").alias("_name"), F.coalesce(one("input", F.lit(True)), F.lit(False)).alias("_input"))


def _recording(devices: DataFrame, listed: DataFrame) -> DataFrame:
    """The devices that can record, with their place among themselves as _nth."""
    if "input" not in devices.columns:
        return listed.withColumn("_nth", F.col("_pos"))
    return global_rank(listed.where("_input"), F.col("_pos"), F.col("_name"), name="_nth").withColumn("_nth", (F.col("_nth") - 1).cast("long"))


def _by(devices: DataFrame, key: str, name: str, *more: str) -> DataFrame:
    """The first device of each `key`, as `name` and _hit, and more of its columns."""
    first = devices.groupBy(F.col(key).alias(name)).agg(F.min(F.struct("_pos", "_name", *more)).alias("_first"))
    return first.where(F.col(name).isNotNull()).select(name, F.struct("_first._pos", "_first._name").alias("_hit"), *[F.col(f"_first.{c}").alias(c) for c in more])


def _asked(queries: DataFrame, prefix: str | None, defaults: tuple[str, ...], ids: bool, trim: bool) -> DataFrame:
    """Distinct queries with their rule, the text that rule looks for (_q) and the position it names (_n)."""
    q = queries.select("query").distinct().withColumn("_q", F.regexp_replace("query", r"^\s+|\s+$", "") if trim else F.col("query"))
    prefixed = F.col("_q").startswith(prefix) if prefix else F.lit(False)
    rule = F.when(F.lower("_q").isin(*defaults), 1)
    by_id, by_prefix = F.col("_q").rlike(ID), prefixed
    rule = rule.when(by_id, 2).when(by_prefix, 3) if ids else rule
    q = q.withColumn("rule", rule.when(_number(F.col("_q")).isNotNull(), 4).otherwise(5))
    rest = F.substr("_q", F.lit(len(prefix or "") + 1))
    return q.withColumn("_n", F.when(F.col("rule") == 3, _number(rest)).when(F.col("rule") == 4, _number(F.col("_q"))))


def _result(rows: DataFrame, error: Column) -> DataFrame:
    ok = F.col("pos").isNotNull()
    return rows.select("query", "pos", F.when(ok, F.col("name")).alias("name"), "rule", F.when(~ok, error).alias("error"))


def find_device(devices: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query the recording device of devices (pos, name, and id and input where there are such columns)."""
    d = _listed(devices)
    can = _recording(devices, d)
    q = _asked(queries, "micidx:", ("default",), True, True)
    first = can.agg(F.min(F.struct("_pos", "_name")).alias("_hit"))
    one = q.where("rule = 1").crossJoin(F.broadcast(first))  # one row
    two = q.where("rule = 2").join(_by(d, "_id", "_q", "_input"), "_q", "left").withColumn("_hit", F.when(F.col("_input"), F.col("_hit")))
    three = q.where("rule in (3, 4)").join(_by(can, "_nth", "_n"), "_n", "left")
    five = q.where("rule = 5").withColumn("_part", F.col("_q"))
    five = five.join(first_with_part(five.select("_part"), can), "_part", "left")
    columns = ["query", "rule", F.col("_hit._pos").alias("pos"), F.col("_hit._name").alias("name")]
    rows = one.select(*columns, F.lit(False).alias("_deaf"), "_n").unionByName(two.select(*columns, F.coalesce(~F.col("_input"), F.lit(False)).alias("_deaf"), "_n"))
    rows = rows.unionByName(three.select(*columns, F.lit(False).alias("_deaf"), "_n")).unionByName(five.select(*columns, F.lit(False).alias("_deaf"), "_n"))
    return _result(rows, _errors())


def _errors() -> Column:
    rule = F.col("rule")
    return (
        F.when(rule == 1, "no default device")
        .when((rule == 2) & F.col("_deaf"), "not an input")
        .when(rule == 2, "no such id")
        .when((rule == 3) & F.col("_n").isNull(), "not a number")
        .when(rule.isin(3, 4), "no such position")
        .otherwise("no such name")
    )


def find_loopback(devices: DataFrame, outputs: DataFrame, queries: DataFrame) -> DataFrame:
    """As find_device, for loopback devices: ``lbidx:N`` and ids name one of devices, which need not record.

    A bare position counts outputs (pos, name; 0 is the default one) and stands for the first loopback device,
    if that output is the default one, or for the first whose name contains the output's. Where it names none,
    and only there, rule 5 follows.
    """
    d = _listed(devices)
    q = _asked(queries, "lbidx:", ("default", "default-output"), True, True)
    first = d.agg(F.min(F.struct("_pos", "_name")).alias("_hit"))
    one = q.where("rule = 1").crossJoin(F.broadcast(first))  # one row
    two = q.where("rule = 2").join(_by(d, "_id", "_q"), "_q", "left")
    three = q.where("rule = 3").join(_by(d, "_pos", "_n"), "_n", "left")
    named = q.where("rule = 4").join(outputs.select(F.col("pos").cast("long").alias("_n"), F.col("name").alias("_part")), "_n")
    head = named.where(F.lower("_part") == "default-output").crossJoin(F.broadcast(first)).select("query", "_hit")
    others = named.where(F.lower("_part") != "default-output")
    hop = others.join(first_with_part(others.select("_part"), d), "_part").select("query", "_hit").unionByName(head)
    hop = hop.where(F.col("_hit").isNotNull()).withColumnRenamed("_hit", "_hop")
    five = q.where("rule in (4, 5)").withColumn("_part", F.col("_q")).join(hop, "query", "left")
    five = five.join(first_with_part(five.select("_part"), d), "_part", "left")
    five = five.withColumn("rule", F.when(F.col("_hop").isNotNull(), 4).otherwise(5)).withColumn("_hit", F.coalesce("_hop", "_hit"))
    columns = ["query", "rule", "_n", F.col("_hit._pos").alias("pos"), F.col("_hit._name").alias("name"), F.lit(False).alias("_deaf")]
    return _result(one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns)).unionByName(five.select(*columns)), _errors())


def find_output(outputs: DataFrame, queries: DataFrame) -> DataFrame:
    """As find_device, for outputs (pos from 0, name) and queries that are taken as they are, untrimmed.

    Position 0 is the default output, N is the output at N - 1; there are no ids and no prefix. The default
    output is the first of the list.
    """
    d = _listed(outputs)
    q = _asked(queries, None, ("default", "default-output"), False, False)
    first = d.agg(F.min(F.struct("_pos", "_name")).alias("_hit"))
    default = (F.col("rule") == 1) | ((F.col("rule") == 4) & (F.col("_n") == 0))
    one = q.where(default).crossJoin(F.broadcast(first))  # one row
    four = q.where((F.col("rule") == 4) & (F.col("_n") > 0)).join(_by(d.withColumn("_nth", F.col("_pos") + 1), "_nth", "_n"), "_n", "left")
    five = q.where("rule = 5").withColumn("_part", F.col("_q"))
    five = five.join(first_with_part(five.select("_part"), d), "_part", "left")
    columns = ["query", "rule", "_n", F.col("_hit._pos").alias("pos"), F.col("_hit._name").alias("name"), F.lit(False).alias("_deaf")]
    return _result(one.select(*columns).unionByName(four.select(*columns)).unionByName(five.select(*columns)), _errors())


def selected_index(devices: DataFrame, queries: DataFrame) -> DataFrame:
    """The place to show as chosen: a token (id) equal to the query, else its position (``micidx:N``, then bare), else
    the first name that contains it, else 0. Here each rule gives way to the next, and queries are not trimmed."""
    d = _listed(devices)
    q = queries.select("query").distinct()
    q = q.withColumn("_n", F.coalesce(F.when(F.col("query").startswith("micidx:"), _number(F.substr("query", F.lit(8)))), _number(F.col("query"))))
    token = d.groupBy(F.col("_id").alias("query")).agg(F.min("_pos").alias("_token")).where("query is not null")
    q = q.join(token, "query", "left").join(d.select(F.col("_pos").alias("_n"), F.col("_pos").alias("_at")).distinct(), "_n", "left")
    part = first_with_part(q.select(F.col("query").alias("_part")), d)
    q = q.withColumn("_part", F.col("query")).join(part, "_part", "left")
    return q.select("query", F.coalesce("_token", "_at", "_hit._pos", F.lit(0).cast("long")).alias("pos"))


def loopback_monitors(devices: DataFrame) -> DataFrame:
    return devices.where(F.lower("name").contains("monitor"))


def with_default_output(devices: DataFrame) -> DataFrame:
    """Output devices from 1, with the synthetic default as 0."""
    head = devices.sparkSession.range(1).select(F.lit(0).alias("pos"), F.lit("default-output").alias("name"))
    return head.unionByName(devices.select((F.col("pos") + 1).alias("pos"), "name"))
