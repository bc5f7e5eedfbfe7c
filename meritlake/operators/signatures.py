"""Profiles and opportunities as signatures of their labels: which fit each other, and counts by score without any pair of rows.

A relation (gate, place, group) asks whether labels fit. Either side is reduced to its distinct labels; those meet in an
equi-join on single labels, so that what is compared is bounded by the labels in use and what they share. Rows carry keys
(of profiles) and numbers (of opportunities).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.sources.tables import numbered, written

#: Scores: for each of four conditions, and for a place where few compete.
POINTS, LOCAL_POINTS, MOST = 25, 10, 100
RELATIONS = ("gate", "place", "group")
#: The labels of ready profiles and opportunities that each relation goes by.
ASKED_BY = {"gate": ["u_disciplines", "u_credentials", "u_level"], "place": ["u_state", "u_metro"], "group": ["u_affiliations", "u_tags"]}
OFFERED_TO = {"gate": ["o_disciplines", "o_credentials", "o_levels"], "place": ["o_states", "o_metros"], "group": ["o_required", "o_tags"]}
#: Numbers in a word of a bit mask; the number that stands for all.
WORD, ALL = 64, -1


def _tokens(labels: Column, mark: str, slot: Column | int = 0) -> Column:
    """Each label, marked by what it is, with its slot; null ones are left out."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    return F.transform(F.filter(labels, lambda x: x.isNotNull()), lambda x: F.struct(F.concat(F.lit(f"{mark}:"), x).alias("token"), slot.alias("slot")))


def _one(token: str, slot: int = 0) -> Column:
    return F.array(F.struct(F.lit(token).alias("token"), F.lit(slot).alias("slot")))


def _asks(mark: str, slot: int, labels: Column) -> Column:
    """What a profile asks by: its labels and 'no restriction'; without labels it fits everything."""
    return F.when(F.size(labels) > 0, F.concat(_tokens(labels, mark, slot), _one(f"{mark}*", slot))).otherwise(_one(f"{mark}**", slot))


def _offers(mark: str, slot: int, labels: Column) -> Column:
    """What an opportunity answers to: its labels, or 'no restriction'; and profiles without labels."""
    return F.concat(F.when(F.size(labels) > 0, _tokens(labels, mark, slot)).otherwise(_one(f"{mark}*", slot)), _one(f"{mark}**", slot))


def profile_tokens() -> dict[str, Column]:
    """By relation, the tokens of a ready profile."""
    level = F.when(F.col("u_level").isNotNull(), F.array("u_level")).otherwise(F.array().cast("array<string>"))
    metro = F.when(F.col("u_metro").isNull(), _one("M*")).otherwise(_tokens(F.array("u_metro"), "M"))
    state = F.when(F.col("u_state").isNull(), _one("S*")).otherwise(_tokens(F.array("u_state"), "S"))
    held = F.transform(F.array_distinct("u_affiliations"), lambda x: F.coalesce(x, F.lit("\0")))
    return {
        "gate": F.concat(_asks("D", 0, F.col("u_disciplines")), _asks("C", 1, F.col("u_credentials")), _asks("L", 2, level)),
        "place": F.concat(metro, state, _one("A")),
        "group": F.concat(_tokens(held, "R"), _tokens(F.array_distinct("u_tags"), "T")),
    }


def opportunity_tokens() -> dict[str, tuple[Column, Column]]:
    """By relation, the tokens of a ready opportunity, and how many slots must be met: one for each kind of label, or for each label that is required."""
    place = F.when(F.size("o_metros") > 0, F.concat(_tokens(F.col("o_metros"), "M"), _one("M*"))).when(F.size("o_states") > 0, F.concat(_tokens(F.col("o_states"), "S"), _one("S*"))).otherwise(_one("A"))
    required = F.transform("o_required", lambda x, k: F.struct(F.concat(F.lit("R:"), F.coalesce(x, F.lit("\0"))).alias("token"), k.alias("slot")))
    return {
        "gate": (F.concat(_offers("D", 0, F.col("o_disciplines")), _offers("C", 1, F.col("o_credentials")), _offers("L", 2, F.col("o_levels"))), F.lit(3)),
        "place": (place, F.lit(1)),
        "group": (F.when(F.size("o_required") > 0, required).otherwise(_tokens(F.array_distinct("o_tags"), "T")), F.greatest(F.size("o_required"), F.lit(1))),
    }


@dataclass
class Coded:
    """users: (user_id, u_gpa, u_sai, u_gate, u_place, u_group, *keep); offered: (opp_id, award, min_gpa, max_sai, low, *offer_keep, gate, place, group);
    fits: (relation, kind, numbers), which opportunities' numbers fit a kind of profile. Profiles that fit the same are of one kind,
    a hash of the numbers (there are as many as label sets in use, far from where 64 bits collide); those that fit none have a null."""

    users: DataFrame
    offered: DataFrame
    fits: DataFrame

    def fit(self, relation: str) -> DataFrame:
        """(u_relation, relation) of one relation."""
        return self.fits.where(F.col("relation") == relation).select(F.col("kind").alias(f"u_{relation}"), F.explode("numbers").alias(relation))


def coded(profiles: DataFrame, opportunities: DataFrame, *keep: str, offer_keep: tuple[str, ...] = ()) -> Coded:
    """Ready profiles and opportunities by signature. A null label matches nothing, but a null that is required matches one that is held."""
    asks, offers = profile_tokens(), opportunity_tokens()
    key = lambda labels: F.md5(F.to_json(F.struct(*labels)).cast("binary"))
    u = written(profiles.select("user_id", "u_gpa", "u_sai", *keep, *sum(ASKED_BY.values(), []), *[key(ASKED_BY[r]).alias(f"{r}_key") for r in RELATIONS]), "profiles")
    o = written(opportunities.select("opp_id", "award", "min_gpa", "max_sai", (F.col("o_competition") == "low").alias("low"), *offer_keep, *sum(OFFERED_TO.values(), []), *[key(OFFERED_TO[r]).alias(f"{r}_key") for r in RELATIONS]), "opportunities")

    def each(df: DataFrame, labels: dict[str, list[str]], made) -> DataFrame:
        """Tokens of each relation's distinct labels."""
        parts = [df.select(F.col(f"{r}_key").alias("key"), *labels[r]).dropDuplicates(["key"]).select(F.lit(r).alias("relation"), "key", *made(r)) for r in RELATIONS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    kinds = numbered(each(o, OFFERED_TO, lambda r: [offers[r][0].alias("tokens"), offers[r][1].alias("need")]), "number", "relation")
    there = kinds.select("relation", "number", "need", F.explode("tokens").alias("t")).select("relation", "number", "need", "t.token", "t.slot")
    asked = each(u, ASKED_BY, lambda r: [asks[r].alias("tokens")]).select("relation", "key", F.explode("tokens").alias("t")).select("relation", "key", "t.token").distinct()
    met = there.join(asked, ["relation", "token"]).groupBy("relation", "key", "number", "need").agg(F.size(F.collect_set("slot")).alias("n")).where("n >= need")
    alike = written(met.groupBy("relation", "key").agg(F.sort_array(F.collect_list("number")).alias("numbers")).withColumn("kind", F.xxhash64("numbers")), "fits")
    users, offered = u.drop(*sum(ASKED_BY.values(), [])), o.drop(*sum(OFFERED_TO.values(), []))
    for r in RELATIONS:
        users = users.join(alike.where(F.col("relation") == r).select(F.col("key").alias(f"{r}_key"), F.col("kind").alias(f"u_{r}")), f"{r}_key", "left").drop(f"{r}_key")
        offered = offered.join(kinds.where(F.col("relation") == r).select(F.col("key").alias(f"{r}_key"), F.col("number").alias(r)), f"{r}_key").drop(f"{r}_key")
    fits = alike.dropDuplicates(["relation", "kind"]).select("relation", "kind", "numbers")
    return Coded(written(users, "profiles"), written(offered, "offered"), fits)


def masks(c: Coded, relation: str) -> DataFrame:
    """(u_relation, relation_bits): the numbers that fit each key, as bits of an array of longs."""
    fit = c.fit(relation).select(f"u_{relation}", F.floor(F.col(relation) / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({relation} % {WORD} as int))").alias("bit"))
    words = fit.groupBy(f"u_{relation}", "word").agg(F.bit_or("bit").alias("bits"))
    listed = words.groupBy(f"u_{relation}").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("last"))
    return listed.select(f"u_{relation}", F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias(f"{relation}_bits"))


def has(bits: str, number: str) -> Column:
    """Whether a number is in a bit mask."""
    return F.expr(f"coalesce(shiftright(get({bits}, cast({number} div {WORD} as int)), cast({number} % {WORD} as int)) & 1L, 0L) = 1")


KINDS = ["u_gate", "u_place", "u_group"]
#: Whether the place and the group fit, by case.
CASES = [(True, True), (True, False), (False, True), (False, False)]


def case_counts(c: Coded, *cell: str) -> DataFrame:
    """(*KINDS, *cell, k, n, total): how many opportunities of each cell pass the gate of a kind of profile in each of CASES, and what they are worth.

    cell: columns of offered, or least, the least GPA. Opportunities are counted by labels and cells, with sums over all
    places, all groups and both beside them (number ALL). A kind of profile meets the places and groups that fit it, and these
    sums; inclusion and exclusion gives what does not fit. No row stands for a profile with an opportunity.
    """
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total")]
    offered = c.offered.withColumn("least", F.coalesce("min_gpa", F.lit(0.0))).groupBy(*RELATIONS, *cell).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("award", F.lit(0))).cast("long").alias("total"))
    of_gate = offered.join(c.fit("gate"), "gate").groupBy("u_gate", "place", "group", *cell).agg(*sums)
    cube = F.explode(F.array(*[F.struct((F.lit(ALL) if p else F.col("place")).alias("place"), (F.lit(ALL) if g else F.col("group")).alias("group")) for p in (True, False) for g in (True, False)]))
    cells = of_gate.select("u_gate", *cell, "n", "total", cube.alias("x")).select("u_gate", "x.*", *cell, "n", "total").groupBy("u_gate", "place", "group", *cell).agg(*sums)
    asking = c.users.select(*KINDS).distinct()
    for r in ("place", "group"):
        mine = c.fits.where(F.col("relation") == r).select(F.col("kind").alias(f"u_{r}"), "numbers")
        asking = asking.join(mine, f"u_{r}", "left").withColumn(r, F.explode(F.concat(F.array(F.lit(ALL).cast("long")), F.coalesce("numbers", F.array().cast("array<long>"))))).drop("numbers")
    # sums over all and over what fits give each case; what only differs in equal points is one
    of = lambda v, p, g: F.sum(F.when(((F.col("place") != ALL) == p) & ((F.col("group") != ALL) == g), F.col(v)).otherwise(0))
    cases: dict[int, list] = {0: [], 1: [], 2: [], 3: []}
    for v in ("n", "total"):
        both, place, group, every = (of(v, p, g) for p, g in ((True, True), (True, False), (False, True), (False, False)))
        for k, case in enumerate((both, place - both, group - both, every - place - group + both)):
            cases[k].append(case.cast("long").alias(v))
    met = asking.join(cells, ["u_gate", "place", "group"]).groupBy(*KINDS, *cell).agg(F.array(*[F.struct(F.lit(k).alias("k"), *v) for k, v in cases.items()]).alias("cases"))
    return met.select(*KINDS, *cell, F.explode("cases").alias("c")).where("c.n > 0").select(*KINDS, *cell, "c.*")


def case_points() -> Column:
    """The points for place and group of case_counts by low."""
    there = F.when(F.col("low"), POINTS + LOCAL_POINTS).otherwise(POINTS)
    return F.get(F.array(there + POINTS, there, F.lit(POINTS), F.lit(0)), F.col("k"))


def by_profile(c: Coded, counts: DataFrame, *by: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, u_gpa, u_sai, *keep, lists): each profile with its kind's counts (*KINDS, *by, least, n, total), a struct for each *by.

    A struct has steps, from the highest least GPA on, with n and total of all up to it: a profile takes the first that it reaches.
    """
    summed = counts.groupBy(*KINDS, *by, "least").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    line = Window.partitionBy(*KINDS, *by).orderBy("least").rowsBetween(Window.unboundedPreceding, 0)
    steps = summed.select(*KINDS, *by, F.struct("least", F.sum("n").over(line).alias("n"), F.sum("total").over(line).alias("total")).alias("s"))
    lists = steps.groupBy(*KINDS, *by).agg(F.sort_array(F.collect_list("s"), asc=False).alias("steps")).groupBy(*KINDS).agg(F.collect_list(F.struct(*by, "steps")).alias("lists"))
    # kinds that fit no place or group have nulls
    same = [c.users[k].eqNullSafe(lists[k]) if k != "u_gate" else c.users[k] == lists[k] for k in KINDS]
    return c.users.join(lists, same).select("user_id", "u_gpa", "u_sai", *keep, "lists")


def parted(x: Column) -> tuple[Column, Column]:
    """Of a struct of by_profile, (n, total) whose least GPA the profile reaches, and of the others."""
    every = F.element_at(x["steps"], 1)
    reached = F.get(F.filter(x["steps"], lambda s: F.col("u_gpa").isNull() | (F.col("u_gpa") >= s["least"])), F.lit(0))
    n, total = F.coalesce(reached["n"], F.lit(0)), F.coalesce(reached["total"], F.lit(0))
    return F.struct(n.alias("n"), total.alias("total")), F.struct((every["n"] - n).alias("n"), (every["total"] - total).alias("total"))


def meets_sai(max_sai: Column) -> Column:
    return max_sai.isNull() | F.coalesce(F.col("u_sai") <= max_sai, F.lit(False))


def score_counts(c: Coded) -> DataFrame:
    """(user_id, score, n, total): how many opportunities that pass the gate have each score for a profile, and what they are worth; by case_counts, without pairs."""
    counts = case_counts(c, "low", "least", "max_sai").withColumn("points", case_points())

    def split(x: Column) -> Column:
        base = x["points"] + F.when(meets_sai(x["max_sai"]), POINTS).otherwise(0)
        reached, others = parted(x)
        return F.array(F.struct((base + POINTS).alias("score"), reached["n"].alias("n"), reached["total"].alias("total")), F.struct(base.alias("score"), others["n"].alias("n"), others["total"].alias("total")))

    mine = by_profile(c, counts, "points", "max_sai")
    rows = mine.select("user_id", F.explode(F.flatten(F.transform("lists", split))).alias("x")).select("user_id", "x.*").where("n > 0")
    return rows.groupBy("user_id", F.least(F.lit(MOST), "score").alias("score")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
