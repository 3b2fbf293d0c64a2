"""Names of people: who is meant by a name, and which names may be one person's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.speech import turn_name_candidates


def with_tokens(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return names.select(F.col(id_col).alias("id"), T.name_tokens(F.col(name_col)).alias("t")).filter("size(t) > 0")


def resolve_people(people: DataFrame, turns: DataFrame) -> DataFrame:
    """(hearing, person, turn) of the turns that are a person's; people: (hearing, person, name), turns: (hearing, turn, raw_name, info).

    A turn is theirs if one of its name candidates matches: equal parts, or one name's inside the other's with two
    or more on both sides. A person of one part whom none matches takes all turns of the only speaker whose
    name holds that part. Names without parts are nobody's. Everything joins on the hearing and a part of the name.
    """
    who = people.select("hearing", "person", T.name_tokens(F.col("name")).alias("p"))
    named = turns.select("hearing", "turn", F.explode(turn_name_candidates(F.col("raw_name"), F.col("info"))).alias("candidate"))
    said = named.select("hearing", "turn", T.normalize_name(F.col("candidate")).alias("speaker"), T.name_tokens(F.col("candidate")).alias("c"))
    met = who.select("hearing", "person", "p", F.explode("p").alias("part")).join(said.withColumn("part", F.explode("c")), ["hearing", "part"])
    direct = met.filter(T.name_contains(F.col("p"), F.col("c"))).select("hearing", "person", "turn").distinct()
    alone = met.filter("size(p) = 1").join(direct, ["hearing", "person"], "left_anti")
    only = alone.groupBy("hearing", "person").agg(F.countDistinct("speaker").alias("n"), F.min("speaker").alias("speaker")).filter("n = 1")
    return direct.union(only.join(said, ["hearing", "speaker"]).select("hearing", "person", "turn").distinct())


def containing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of token tables whose names match: equal sets, or one in the other with two tokens or more on both sides.

    Candidates meet by token with a count of what they share; only counts that fill the smaller set remain.
    """
    left = a.select(F.col("id").alias("a"), F.size("t").alias("na"), F.explode("t").alias("token"))
    right = b.select(F.col("id").alias("b"), F.size("t").alias("nb"), F.explode("t").alias("token"))
    shared = left.join(right, "token").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return shared.filter("n = least(na, nb) and (na = nb or least(na, nb) >= 2)").select("a", "b")


def resolve_single_tokens(names: DataFrame, speakers: DataFrame) -> DataFrame:
    """(a, b): a one-token name and the only speaker that holds it."""
    one = names.filter("size(t) = 1").select(F.col("id").alias("a"), F.col("t")[0].alias("token"))
    held = speakers.select(F.col("id").alias("b"), F.explode("t").alias("token"))
    found = one.join(held, "token").groupBy("a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b"))
    return found.filter("n = 1").select("a", "b")


def ambiguous_pairs(names: DataFrame) -> DataFrame:
    """(a, b), a before b: names whose token sets are equal or one inside the other."""
    left = names.select(F.col("id").alias("a"), F.size("t").alias("na"), F.explode("t").alias("token"))
    right = names.select(F.col("id").alias("b"), F.size("t").alias("nb"), F.explode("t").alias("token"))
    shared = left.join(right, "token").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return shared.filter("n = least(na, nb)").select("a", "b")
