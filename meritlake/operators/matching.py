"""Who may have what: hard gates, soft scores with explanations, and ranked feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.functions.checks import opt_float, str_list
from meritlake.functions.labels import discipline_of, filled, level_of, lowered, metro_of, strings
from meritlake.operators import signatures
from meritlake.operators.signatures import LOCAL_POINTS, MOST, POINTS, Coded, coded, score_counts
from meritlake.sources.tables import few, numbered, written


#: Pairs that a task sorts; pairs that a task looks at where few are kept; tasks at most.
PAIRS_A_TASK, LOOKS_A_TASK, MOST_TASKS = 1 << 20, 1 << 25, 20_000
#: Pairs that a task sorts as numbers, a profile's in an array; bits of such a number that are the opportunity's place.
NUMBERS_A_TASK, PLACE_BITS = 1 << 19, 40
#: A limited feed looks at so many opportunities of the highest awards first, then at so many times as many, in the end at all.
FIRST_ROWS, MORE_ROWS = 2048, 16


def _listed(array: Column, single: Column) -> Column:
    """The array if it has anything, else the single value if there is one."""
    return F.when(F.size(filled(array)) > 0, array).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def ready_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with what matching compares worked out once: labels, level, area, tags."""
    studied = _listed(F.col("disciplines"), F.col("primary_discipline"))
    affiliations = lowered(F.col("affiliations"))
    tags = F.array_union(
        affiliations,
        F.concat(
            F.when(F.col("first_gen"), strings(["first_gen", "first-generation"])).otherwise(strings([])),
            F.when(F.col("minority"), strings(["minority", "underrepresented"])).otherwise(strings([])),
        ),
    )
    return profiles.select(
        "user_id",
        F.array_union(lowered(studied), F.transform(studied, discipline_of)).alias("u_disciplines"),
        _listed(F.col("target_credentials"), F.col("target_credential")).alias("u_credentials"),
        level_of(F.col("clinical_phase")).alias("u_level"),
        F.col("gpa").alias("u_gpa"),
        F.upper(F.nullif(F.col("state"), F.lit(""))).alias("u_state"),
        F.when(F.col("metro") != "", metro_of(F.col("metro"))).alias("u_metro"),
        F.col("sai").alias("u_sai"),
        affiliations.alias("u_affiliations"),
        tags.alias("u_tags"),
        F.col("tier").alias("u_tier"),
    )


def ready_opportunities(opportunities: DataFrame) -> DataFrame:
    """Opportunities with what matching compares worked out once; archived ones are left out (a null flag is not archived)."""
    low = lowered(F.col("disciplines"))
    return opportunities.where(~F.coalesce("is_archived", F.lit(False))).select(
        "opp_id", "title", "provider", "portal_url", "award", "deadline", "min_gpa", "max_sai", "states", "metros", "required_affiliations", "tags", "has_service_commitment", "employment_required",
        F.when(F.array_contains(low, "any"), strings([])).otherwise(low).alias("o_disciplines"),
        filled(F.col("credentials")).alias("o_credentials"),
        lowered(F.col("levels")).alias("o_levels"),
        F.transform(filled(F.col("states")), F.upper).alias("o_states"),
        F.transform(filled(F.col("metros")), metro_of).alias("o_metros"),
        F.array_distinct(lowered(F.col("required_affiliations"))).alias("o_required"),
        lowered(F.col("tags")).alias("o_tags"),
        F.coalesce("competition", F.lit("medium")).alias("o_competition"),
    )


def known_pairs(pairs: DataFrame, profiles: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Given pairs (user_id, opp_id) with all columns of ready_profiles and ready_opportunities.

    What moves with a pair from its profile to its opportunity are numbers: label sets go by a hash, as few are in use, and are joined last.
    """
    u = ready_profiles(profiles)
    kinds = {"gate": ["u_disciplines", "u_credentials", "u_level"], "place": ["u_state", "u_metro"], "group": ["u_affiliations", "u_tags"], "tier": ["u_tier"]}
    keys = {f"u_{k}_key": F.xxhash64(F.to_json(F.struct(*cols))) for k, cols in kinds.items()}
    out = pairs.select("user_id", "opp_id").join(u.select("user_id", "u_gpa", "u_sai", *[key.alias(k) for k, key in keys.items()]), "user_id").join(ready_opportunities(opportunities), "opp_id")
    for (k, key), cols in zip(keys.items(), kinds.values(), strict=True):
        out = out.join(few(ready_profiles(profiles).select(key.alias(k), *cols).distinct()), k).drop(k)
    return out


def discipline_gate() -> Column:
    """No restriction, nothing studied, or a common discipline."""
    return (F.size("o_disciplines") == 0) | (F.size("u_disciplines") == 0) | F.arrays_overlap("o_disciplines", "u_disciplines")


def credential_gate() -> Column:
    """No restriction, no credential, or a common one in the same case."""
    return (F.size("o_credentials") == 0) | (F.size("u_credentials") == 0) | F.arrays_overlap("o_credentials", "u_credentials")


def level_gate() -> Column:
    """No restriction, no phase, or its level."""
    return (F.size("o_levels") == 0) | F.col("u_level").isNull() | F.coalesce(F.array_contains("o_levels", F.col("u_level")), F.lit(False))


def _gpa() -> Column:
    return F.col("u_gpa").isNull() | (F.col("u_gpa") >= F.coalesce("min_gpa", F.lit(0.0)))


def _sai() -> Column:
    return F.col("max_sai").isNull() | F.coalesce(F.col("u_sai") <= F.col("max_sai"), F.lit(False))


def _place() -> Column:
    metro = F.col("u_metro").isNull() | F.coalesce(F.array_contains("o_metros", F.col("u_metro")), F.lit(False))
    state = (F.size("o_states") == 0) | F.col("u_state").isNull() | F.coalesce(F.array_contains("o_states", F.col("u_state")), F.lit(False))
    return F.when(F.size("o_metros") > 0, metro).otherwise(state)


def _belongs() -> Column:
    return F.when(F.size("o_required") > 0, F.size(F.array_except("o_required", "u_affiliations")) == 0).otherwise(F.arrays_overlap("u_tags", "o_tags"))


def with_scores(pairs: DataFrame) -> DataFrame:
    """pairs with points by kind and their sum, 100 at most. Columns are those of ready_profiles and ready_opportunities."""
    points = lambda met, n: F.when(met, n).otherwise(0)
    scored = pairs.withColumns({"gpa_points": points(_gpa(), POINTS), "geo_points": points(_place(), POINTS), "sai_points": points(_sai(), POINTS), "affiliation_points": points(_belongs(), POINTS)})
    scored = scored.withColumn("local_points", points((F.col("o_competition") == "low") & (F.col("geo_points") > 0), LOCAL_POINTS))
    return scored.withColumn("score", F.least(F.lit(100), sum((F.col(f"{k}_points") for k in ("geo", "sai", "affiliation", "local")), F.col("gpa_points"))))


def _missing(max_sai: Column | None = None) -> dict[str, Column]:
    """What is said of each kind of points that a pair lacks; all but sai are of the opportunity alone. max_sai: where that is no column."""
    max_sai = F.col("max_sai") if max_sai is None else max_sai
    joined = lambda c: F.array_join(c, ", ")
    yours = F.concat(F.lit("Requires SAI <= "), max_sai.cast("string"), F.lit(" (yours is "), F.col("u_sai").cast("string"), F.lit(")"))
    return {
        "gpa": F.concat(F.lit("Requires GPA >= "), F.col("min_gpa").cast("string")),
        "sai": F.when(F.col("u_sai").isNull(), "Requires demonstrated financial need").otherwise(yours),
        "geo": F.when(F.size("o_metros") > 0, F.concat(F.lit("Restricted to the "), joined("metros"), F.lit(" area"))).otherwise(F.concat(F.lit("Restricted to residents of: "), joined("states"))),
        "affiliation": F.when(F.size("o_required") > 0, F.concat(F.lit("Requires affiliation(s): "), joined("required_affiliations"))).when(F.size("o_tags") > 0, F.concat(F.lit("Preferenced tags not matched: "), joined("tags"))),
    }


def _notices() -> list[Column]:
    return [
        F.when(F.col("has_service_commitment"), "Includes post-graduation service commitment"),
        F.when(F.col("employment_required"), "Requires employment or clinical apprenticeship"),
    ]


def with_messages(scored: DataFrame) -> DataFrame:
    """scored with messages: what is missing below 100 points, then the two notices."""
    short = F.array(*[F.when(F.col(f"{k}_points") == 0, text) for k, text in _missing().items()])
    notices = F.array(*_notices())
    missing = F.when(F.col("score") < 100, F.array_compact(short)).otherwise(strings([]))
    return scored.withColumn("messages", F.array_union(missing, F.array_compact(notices)))


def n_pairs(c: Coded, users: DataFrame) -> int:
    """How many pairs pass the gates: by kinds, without pairs."""
    n = c.offered.groupBy("gate").agg(F.count(F.lit(1)).alias("n")).join(c.fit("gate"), "gate").groupBy("u_gate").agg(F.sum("n").alias("n"))
    asking = users.groupBy("u_gate").agg(F.count(F.lit(1)).alias("m"))
    return int(n.join(asking, "u_gate").agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("m"))).first()[0] or 0)


def flagged_pairs(c: Coded, users: DataFrame, per_task: int = PAIRS_A_TASK) -> DataFrame:
    """All columns of users (of c, or rows of its with more columns) and c.offered, with gpa_ok, sai_ok, there and belongs: all pairs that pass the gates.

    A pair costs an equi-join on its gate's number, two bits and two comparisons. Bits join a profile's gates by its kind.
    Profiles are dealt by user_id to tasks of so many pairs, which the join keeps where opportunities are broadcast (a
    bounded number, beyond it by Spark's own rule); so pairs of a profile meet without a shuffle, and a task sorts them in memory.
    """
    parts = max(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-n_pairs(c, users) // per_task)))
    asked = users.join(c.fit("gate"), "u_gate").drop("u_gate")
    asked = asked.join(signatures.masks(c, "place"), "u_place", "left").join(signatures.masks(c, "group"), "u_group", "left").drop("u_place", "u_group").repartition(parts, "user_id")
    flags = {"gpa_ok": _gpa(), "sai_ok": _sai(), "there": signatures.has("place_bits", "place"), "belongs": signatures.has("group_bits", "group")}
    return asked.join(few(c.offered), "gate").withColumns(flags).drop("gate", "place", "group", "place_bits", "group_bits")


def flagged_score() -> Column:
    """The score of flagged_pairs."""
    points = lambda met, n: F.when(F.col(met), n).otherwise(0)
    return F.least(F.lit(100), points("gpa_ok", POINTS) + points("sai_ok", POINTS) + points("belongs", POINTS) + points("there", F.when(F.col("low"), POINTS + LOCAL_POINTS).otherwise(POINTS)))


def coded_pairs(c: Coded, users: DataFrame, *keep: str, per_task: int = PAIRS_A_TASK) -> DataFrame:
    """(user_id, opp_id, award, score, *keep) of flagged_pairs."""
    return flagged_pairs(c, users, per_task).select("user_id", "opp_id", "award", flagged_score().alias("score"), *keep)


def eligible_pairs(profiles: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, opp_id, award, score): all pairs of ready profiles and opportunities that pass the gates."""
    c = coded(profiles, opportunities)
    return coded_pairs(c, c.users)


def feed_totals(profiles: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, n, total, best, perfect) of ready profiles that may have anything: from counts by score, without pairs."""
    counts = score_counts(coded(profiles, opportunities))
    return counts.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("score").alias("best"), F.sum(F.when(F.col("score") >= 100, F.col("n")).otherwise(0)).alias("perfect"))


def _least_scores(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, least, n_over, need): the highest score such that wanted pairs of the user, (user_id, wanted), at least have it or more, else the lowest;
    how many have more, and how many of the first wanted pairs there are."""
    above = counts.withColumn("above", F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("score")))).join(wanted, "user_id")
    reached = F.max(F.when(F.col("above") >= F.col("wanted"), F.col("score")))
    each = above.groupBy("user_id").agg(F.coalesce(reached, F.min("score")).alias("least"), F.collect_list(F.struct("score", "n")).alias("all"), F.sum("n").alias("total"), F.max("wanted").alias("wanted"))
    over = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["score"] > F.col("least"), x["n"]).otherwise(0))
    return each.select("user_id", "least", over.alias("n_over"), F.least("total", "wanted").alias("need"))


def _prefixes(offered: DataFrame) -> list[DataFrame]:
    """The opportunities of the highest awards, then more of them, in the end all; in the order of feeds, equal awards by opp_id."""
    a, n = F.coalesce("award", F.lit(0)), offered.count()
    out, size = [], FIRST_ROWS
    while size * MORE_ROWS < n:
        cut = offered.agg(F.percentile_approx(a, 1 - size / n, 10_000).alias("cut")).first()["cut"]
        over, same = (offered.where(a > cut).count(), offered.where(a == cut))
        share = min(1.0, max(0, size - over) / max(1, same.count()))
        last = same.agg(F.percentile_approx("opp_id", share, 10_000).alias("last")).first()["last"]  # any cut is a prefix; a rough one costs or saves some rows
        out.append(offered.where((a > cut) | ((a == cut) & (F.col("opp_id") <= last))))
        size *= MORE_ROWS
    return [*out, offered]


def _top_pairs(c: Coded, wanted: DataFrame, order, *keep: str) -> DataFrame:
    """(user_id, opp_id, award, score, rank, *keep): the first pairs of each user of wanted (users of c with wanted, how many), all scores counted beforehand.

    Pairs of a score come by award. So a prefix of the opportunities by award settles a user if it has all pairs above the
    user's least score and enough of that score; only users that it leaves open look at the next, larger one, and the last holds all.
    """
    least = _least_scores(score_counts(c), wanted.select("user_id", "wanted"))
    open_ = written(wanted.join(least, "user_id"), "least")  # a table, or else the few rows that counting ends with would be one task
    mine = Window.partitionBy("user_id")
    found = []
    rounds = _prefixes(c.offered)
    for k, offered in enumerate(rounds):
        part = Coded(c.users, offered if k == len(rounds) - 1 else written(offered, "prefix"), c.fits)
        pairs = coded_pairs(part, open_, "least", "n_over", "need", "wanted", *keep, per_task=LOOKS_A_TASK).where("score >= least")
        first = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= wanted")
        settled = (F.count(F.lit(1)).over(mine) == F.col("need")) & (F.count_if(F.col("score") > F.col("least")).over(mine) == F.col("n_over"))
        got = first.withColumn("settled", settled)
        if k == len(rounds) - 1:
            found.append(got.drop("settled"))
            break
        got = written(got.where("settled").drop("settled"), "settled")
        found.append(got)
        open_ = written(open_.join(got.select("user_id").distinct(), "user_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("least", "n_over", "need", "wanted")


def _whole_feeds(c: Coded, users: DataFrame, left: Column, *keep: str) -> DataFrame:
    """(user_id, opp_id, award, score, rank, *keep): all pairs of users for which left holds, ranked.

    Opportunities are numbered in the order of feeds beforehand, so a pair is one number, of its score and that place; a
    profile's numbers are sorted as an array, and their places looked up. keep: of a profile, so of one row of each user_id.
    """
    placed = written(numbered(c.offered.orderBy(F.desc(F.coalesce("award", F.lit(0))), "opp_id"), "place_no"), "placed")
    pairs = flagged_pairs(Coded(c.users, placed, c.fits), users, NUMBERS_A_TASK).where(left)
    number = F.shiftleft((MOST - flagged_score()).cast("long"), PLACE_BITS).bitwiseOR(F.col("place_no"))
    lists = pairs.select("user_id", number.alias("number"), *keep).groupBy("user_id").agg(F.sort_array(F.collect_list("number")).alias("numbers"), *[F.first(k).alias(k) for k in keep])
    ranked = lists.select("user_id", *keep, F.posexplode("numbers").alias("at", "number"))
    ranked = ranked.select("user_id", *keep, (F.col("at") + 1).alias("rank"), (MOST - F.shiftright("number", PLACE_BITS)).cast("int").alias("score"), F.col("number").bitwiseAND((1 << PLACE_BITS) - 1).alias("place_no"))
    return ranked.join(few(placed.select("place_no", "opp_id", "award")), "place_no").select("user_id", "opp_id", "award", "score", "rank", *keep)


def ranked_pairs(profiles: DataFrame, opportunities: DataFrame, dismissed: DataFrame | None = None, top: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, opp_id, award, score, rank, *keep): each profile's feed by score, then award, both falling, then opp_id; keep: columns of ready profiles.

    dismissed: (user_id, opp_id) pairs to leave out; a profile takes the list of its own along. top: the length of a feed, if
    it is limited; then counts by score say which score a pair must have to be among the top, and only such pairs are sorted.
    """
    c = coded(ready_profiles(profiles), ready_opportunities(opportunities), *keep)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc(F.coalesce("award", F.lit(0))), "opp_id")
    users, left = c.users, F.lit(True)
    if dismissed is not None:
        gone = dismissed.groupBy("user_id").agg(F.collect_set("opp_id").alias("gone"))
        users = written(users.join(gone, "user_id", "left"), "dismissed")
        left = F.col("gone").isNull() | ~F.array_contains("gone", F.col("opp_id"))
    kept = [*keep, *(["gone"] if dismissed is not None else [])]
    columns = ["user_id", "opp_id", "award", "score", *keep]
    place = F.row_number().over(order)
    if top is None:
        return _whole_feeds(c, users, left, *keep)
    more = F.lit(0) if dismissed is None else F.coalesce(F.size("gone"), F.lit(0))  # as many more as may be left out
    pairs = _top_pairs(c, users.withColumn("wanted", top + F.greatest(more, F.lit(0))), order, *kept)
    return pairs if dismissed is None else pairs.where(left).select(*columns).withColumn("rank", place).where(F.col("rank") <= top)


def ranked_feed(profiles: DataFrame, opportunities: DataFrame, dismissed: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """ranked_pairs with all columns of profile and opportunity, points and messages."""
    ranked = ranked_pairs(profiles, opportunities, dismissed, top).select("user_id", "opp_id", "rank")
    return with_messages(with_scores(ranked.join(ready_opportunities(opportunities), "opp_id").join(ready_profiles(profiles), "user_id")))


def holds_word(word: str) -> Column:
    """Whether title, provider or a message of a scored pair holds word in any case; percent signs and underscores are themselves."""
    low = word.lower()
    return F.lower("title").contains(low) | F.lower("provider").contains(low) | F.exists("messages", lambda m: F.lower(m).contains(low))


def _says(word: str) -> Callable[[Column], Column]:
    """Whether a text holds word in any case; a null one does not."""
    return lambda text: F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))


def _word_marks(word: str) -> dict[str, Column]:
    """Of a ready opportunity: whether it says word always, or where a pair lacks GPA, place or group; and whether it is of no area."""
    said, texts = _says(word), _missing()
    always = said(F.col("title")) | said(F.col("provider"))
    for notice in _notices():
        always = always | said(notice)
    return {"says": always, "says_gpa": said(texts["gpa"]), "says_geo": said(texts["geo"]), "says_affiliation": said(texts["affiliation"]), "anywhere": F.size("o_metros") == 0}


def worded_pairs(profiles: DataFrame, opportunities: DataFrame, word: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, opp_id, award, score, in_area, *keep): all eligible pairs whose title, provider or a message holds word in any case, as holds_word has it.

    in_area: the profile names no area, or the opportunity does not, or it is one of its. What an opportunity alone says is
    looked through once for it, not for each pair; pairs of a profile meet without a shuffle. keep: columns of ready profiles.
    """
    return _worded_pairs(_worded(profiles, opportunities, word, keep), word, keep)


def _worded(profiles: DataFrame, opportunities: DataFrame, word: str, keep: tuple[str, ...]) -> Coded:
    marks = _word_marks(word)
    return coded(ready_profiles(profiles), ready_opportunities(opportunities).withColumns(marks), *keep, offer_keep=tuple(marks))


def _worded_pairs(c: Coded, word: str, keep: tuple[str, ...]) -> DataFrame:
    said = _says(word)
    pairs = flagged_pairs(c, c.users, LOOKS_A_TASK).withColumn("score", flagged_score())
    lacks = (~F.col("gpa_ok") & F.col("says_gpa")) | (~F.col("there") & F.col("says_geo")) | (~F.col("belongs") & F.col("says_affiliation")) | (~F.col("sai_ok") & said(_missing()["sai"]))
    return pairs.where(F.col("says") | ((F.col("score") < 100) & lacks)).select("user_id", "opp_id", "award", "score", (F.col("anywhere") | F.col("there")).alias("in_area"), *keep)


def worded_totals(profiles: DataFrame, opportunities: DataFrame, word: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, total, worth, best, *keep): how many of worded_pairs in its areas each profile has, their awards and best score, if there are any.

    From counts by kind of profile, without pairs: place and group decide most of what a pair says, and what it says of GPA
    and SAI goes by the profile's own. A pair that lacks anything has less than 100 points, so messages are never left out.
    As many pairs as one task looks at are looked at instead, which takes fewer steps.
    """
    said, c = _says(word), _worded(profiles, opportunities, word, keep)
    if n_pairs(c, c.users) <= LOOKS_A_TASK:
        pairs = _worded_pairs(c, word, keep).where("in_area")
        return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("award", F.lit(0))).cast("long").alias("worth"), F.max("score").alias("best"), *[F.first(k).alias(k) for k in keep])
    there = F.get(F.array(*[F.lit(t) for t, _ in signatures.CASES]), F.col("k"))
    belongs = F.get(F.array(*[F.lit(b) for _, b in signatures.CASES]), F.col("k"))
    always = F.col("says") | (~there & F.col("says_geo")) | (~belongs & F.col("says_affiliation"))
    counts = signatures.case_counts(c, "low", "least", "max_sai", "says", "says_gpa", "says_geo", "says_affiliation", "anywhere").where(F.col("anywhere") | there).withColumns({"points": signatures.case_points(), "always": always})
    counts = counts.where("always or says_gpa or max_sai is not null")  # others say nothing whatever they lack

    def split(x: Column) -> Column:
        met = signatures.meets_sai(x["max_sai"])
        base = x["points"] + F.when(met, POINTS).otherwise(0)
        holds = x["always"] | (~met & said(_missing(x["max_sai"])["sai"]))
        reached, others = signatures.parted(x)
        entry = lambda counted, score, n: F.struct(F.least(F.lit(100), score).alias("score"), F.when(counted, n["n"]).otherwise(0).alias("n"), F.when(counted, n["total"]).otherwise(0).alias("total"))
        return F.array(entry(holds, base + POINTS, reached), entry(holds | x["says_gpa"], base, others))

    mine = signatures.by_profile(c, counts, "points", "max_sai", "always", "says_gpa", keep=keep)
    rows = mine.select("user_id", *keep, F.explode(F.flatten(F.transform("lists", split))).alias("x")).select("user_id", *keep, "x.*").where("n > 0")
    return rows.groupBy("user_id").agg(F.sum("n").alias("total"), F.sum("total").alias("worth"), F.max("score").alias("best"), *[F.first(k).alias(k) for k in keep])


def records(scored: DataFrame) -> DataFrame:
    """Scored pairs with messages as result records: missing values as their defaults, 0 as no least GPA or largest SAI, points as a map."""
    kinds = ("gpa", "geo", "sai", "affiliation", "local")
    points = F.map_from_arrays(strings(list(kinds)), F.array(*[F.col(f"{k}_points") for k in kinds]))
    return scored.select(
        "user_id", "opp_id", "title", "provider", "portal_url", F.coalesce("award", F.lit(0)).alias("award_amount"), F.coalesce(F.col("deadline").cast("string"), F.lit("")).alias("deadline"), "score", F.col("messages").alias("missing_criteria"),
        opt_float(F.col("min_gpa")).alias("min_gpa"), opt_float(F.col("max_sai")).alias("max_sai"), str_list(F.col("states")).alias("state_restrictions"), str_list(F.col("metros")).alias("metro_restrictions"),
        F.col("o_disciplines").alias("eligible_disciplines"), F.col("o_credentials").alias("eligible_credentials"), F.coalesce("has_service_commitment", F.lit(False)).alias("has_service_commitment"),
        F.coalesce("employment_required", F.lit(False)).alias("employment_required"), points.alias("score_breakdown"),
    )


#: What a profile may hold, for forms that leave most of it out.
FORM = {
    "disciplines": "array<string>", "primary_discipline": "string", "target_credentials": "array<string>", "target_credential": "string", "clinical_phase": "string", "gpa": "double", "state": "string", "metro": "string",
    "sai": "int", "affiliations": "array<string>", "first_gen": "boolean", "minority": "boolean", "tier": "string",
}


def preview(forms: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(user_id, projected_count, projected_funding_total) for partly filled profiles; opportunities without an archive flag do not count."""
    whole = forms.select("user_id", *[F.col(c) if c in forms.columns else F.lit(None).cast(kind).alias(c) for c, kind in FORM.items()])
    counted = feed_totals(ready_profiles(whole), ready_opportunities(opportunities.where("not is_archived"))).select("user_id", "n", "total")
    return forms.select("user_id").join(counted, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("projected_count"), F.coalesce("total", F.lit(0)).alias("projected_funding_total"))
