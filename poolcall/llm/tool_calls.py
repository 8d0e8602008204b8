"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolcall.scaling import rank_in_groups
from poolcall.session import cut

SALTS = 16  # a conversation's calls meet its flags under so many keys
FITS = {  # JSON schema type to the start of the type names of a value
    "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "string": ["STRING"],
    "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"],
}


def in_flagged(calls: DataFrame, conversations: DataFrame, how: str) -> DataFrame:
    """``calls`` joined with ``conversations(conv_id, ...)``, one row each; a very long conversation meets it in several tasks."""
    salt = F.pmod(F.xxhash64("call_id"), F.lit(SALTS)).cast("int")
    spread = conversations.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return calls.withColumn("salt_", salt).join(spread, ["conv_id", "salt_"], how).drop("salt_")


def shorten(waits: DataFrame, longest: int) -> DataFrame:
    """One round over ``waits(conv_id, call_id, at, step, on, k)``: a call's place is at least ``(at, step)`` and ``k`` steps after ``on``.

    A link to a call that waits for at most one other is replaced by a link to what that one waits for, with both step
    counts added, so a chain halves with each round and no round has more links than the last. ``turned`` marks a link
    that came back to its own call or is longer than any order allows: a cycle, which is dropped."""
    held = waits.groupBy("conv_id", F.col("call_id").alias("on")).agg(
        F.max(F.struct("at", "step")).alias("p"), F.count("on").alias("links"), F.max("on").alias("next"), F.max("k").alias("more"))
    met = waits.join(held, ["conv_id", "on"], "left")
    free = F.coalesce(F.col("links") <= 1, F.lit(False))
    own = F.struct("at", "step")
    place = F.when(free, F.greatest(own, F.struct(F.col("p.at").alias("at"), (F.col("p.step") + F.col("k")).alias("step")))).otherwise(own)
    moved = met.select("conv_id", "call_id", place.alias("p"), F.when(free, F.col("next")).otherwise(F.col("on")).alias("on"),
                       F.when(free, F.col("k") + F.col("more")).otherwise(F.col("k")).alias("k"), free.alias("moved"), "turned")
    turned = F.coalesce((F.col("on") == F.col("call_id")) | (F.col("k") >= longest), F.lit(False))
    ended = moved.withColumn("turned", F.col("turned") | turned).withColumn("on", F.when(~turned, F.col("on")))
    return (ended.groupBy("conv_id", "call_id", "on").agg(F.max("p").alias("p"), F.max("k").alias("k"), F.max("moved").alias("moved"), F.max("turned").alias("turned"))
            .select("conv_id", "call_id", "p.at", "p.step", "on", F.when(F.col("on").isNotNull(), F.col("k")).alias("k"), "moved", "turned"))


def order_calls(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """``calls(conv_id, call_id, turn)`` with ``depends(conv_id, call_id, on)`` to ``(conv_id, call_id, seq, late)``.

    ``seq`` numbers the calls of a conversation from 1 so that each comes after those it depends on, otherwise by turn and
    call_id. A call's place is the larger of its own turn and the places it depends on, one step after a place taken over.
    Where every link points to an earlier turn, turns are such an order already, so only conversations with a link to
    the same or a later turn are worked on, by :func:`shorten` until no link is left: about the logarithm of the longest chain in rounds, more
    only where calls with several links each follow one another. A round that moves nothing leaves only cycles. In a conversation
    with a cycle all calls are ``late`` and ordered by turn and call_id. Links to unknown calls or to the call itself do not count."""
    turns = calls.select("conv_id", "call_id", "turn")
    links = (depends.select("conv_id", "call_id", "on").filter("call_id <> on").distinct().join(turns, ["conv_id", "call_id"])
             .join(turns.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("turn_on")), ["conv_id", "on"]))
    links = cut(links)
    worked = cut(links.filter("turn_on >= turn").select("conv_id").distinct())
    longest = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    mine = in_flagged(links, worked, "left_semi")
    waits = cut(in_flagged(turns, worked, "left_semi").join(mine.select("conv_id", "call_id", "on"), ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.col("turn").alias("at"), F.lit(0).alias("step"), "on", F.when(F.col("on").isNotNull(), F.lit(1)).alias("k"), F.lit(False).alias("moved"), F.lit(False).alias("turned")))
    while not waits.filter("on IS NOT NULL").isEmpty():
        waits = cut(shorten(waits, longest))
        if waits.filter("moved").isEmpty():
            break
    late = waits.filter("turned OR on IS NOT NULL").select("conv_id").distinct().withColumn("late", F.lit(True))
    places = waits.groupBy("conv_id", "call_id").agg(F.max(F.struct("at", "step")).alias("p"))
    placed = in_flagged(turns.join(places, ["conv_id", "call_id"], "left"), late, "left").withColumn("late", F.coalesce("late", F.lit(False)))
    at = F.when(F.col("late") | F.col("p").isNull(), F.struct(F.col("turn").alias("at"), F.lit(0).alias("step"))).otherwise(F.col("p"))
    return rank_in_groups(placed.select("conv_id", "call_id", "turn", "late", at.alias("p")), ["conv_id"], [F.col("p.at"), F.col("p.step"), F.col("turn"), F.col("call_id")], "seq").select(
        "conv_id", "call_id", F.col("seq").cast("bigint").alias("seq"), "late")


def faults(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls(conv_id, call_id, name, args variant)`` and ``schemas(name, param, type, required)`` to ``(conv_id, call_id, errors)``.

    Arguments become rows that meet the parameters of the tool in a hash join: unknown tools and parameters, wrong types and
    missing required parameters are told, sorted. Calls without a fault do not appear."""
    tools = schemas.select("name").distinct().withColumn("known", F.lit(True))
    whole = calls.join(tools, "name", "left").select("conv_id", "call_id", "name", "args", F.coalesce("known", F.lit(False)).alias("known"))
    kind = F.when(F.col("args").isNull(), F.lit("arguments are not JSON")).when(~F.schema_of_variant("args").startswith("OBJECT"), F.lit("arguments are not an object"))
    plain = whole.select("conv_id", "call_id", "name", F.when(~F.col("known"), F.lit("unknown tool")).otherwise(kind).alias("error"), "args")
    fine = plain.filter("error IS NULL")
    given = fine.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("args").outer())).select(
        "conv_id", "call_id", "name", F.col("key").alias("param"), F.schema_of_variant("value").alias("got"))
    met = given.join(schemas, ["name", "param"], "left")
    fits = F.lit(False)
    for t, starts in FITS.items():
        for s in starts:
            fits = fits | ((F.col("type") == t) & F.col("got").startswith(s))
    wrong = met.select("conv_id", "call_id", F.when(F.col("type").isNull(), F.concat(F.lit("unknown parameter "), "param"))
                       .when(~fits, F.concat(F.lit("wrong type of "), "param")).alias("error"))
    needed = fine.select("conv_id", "call_id", "name").join(schemas.filter("required").select("name", "param"), "name")
    missing = needed.join(given.select("conv_id", "call_id", "param"), ["conv_id", "call_id", "param"], "left_anti").select("conv_id", "call_id", F.concat(F.lit("missing "), "param").alias("error"))
    every = plain.select("conv_id", "call_id", "error").unionAll(wrong).unionAll(missing).filter("error IS NOT NULL")
    return every.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("error")).alias("errors"))


def quoted(name: str) -> Column:
    """The JSON value of a string column, ``null`` included."""
    record = F.to_json(F.struct(F.col(name).alias("c")), {"ignoreNullFields": "false"})
    return F.substring(record, F.lit(6), F.length(record) - 6)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, depends: DataFrame) -> DataFrame:
    """``calls(conv_id, turn, call_id, name, arguments)``, ``results(conv_id, call_id, content)``, ``schemas(name, param, type,
    required)`` and ``depends(conv_id, call_id, on)`` to one row a call: ``(conv_id, seq, call_id, name, linked, valid, errors, late, json)``.

    ``json`` is canonical: keys sorted at every depth, no spaces. A call without a result has ``"result":null`` and is not linked; of several results
    the smallest text counts; results without a call are left out. A repeated (conv_id, call_id) keeps the row with the smallest turn, then name
    and arguments. Rows without conv_id, call_id or turn take no part. Arguments that are not a JSON object are invalid and stand in the
    record as null. Empty tables give empty results; further columns are ignored."""
    chosen = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments")).alias("c"))
    known = cut(chosen.select("conv_id", "call_id", "c.turn", "c.name", "c.arguments"))
    parsed = known.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("args"))
    one = results.filter("content IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"))
    order = order_calls(known, depends)
    rows = (known.join(parsed.select("conv_id", "call_id", "args"), ["conv_id", "call_id"]).join(one, ["conv_id", "call_id"], "left")
            .join(faults(parsed, schemas), ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"]))
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    arguments = F.when(F.schema_of_variant("args").startswith("OBJECT"), F.to_json("args")).otherwise(F.lit("null"))
    json = F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'),
                    quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}"))
    return rows.select("conv_id", "seq", "call_id", "name", F.col("content").isNotNull().alias("linked"), (F.size(errors) == 0).alias("valid"), errors.alias("errors"), "late", json.alias("json"))
