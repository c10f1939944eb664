"""Meal planning from nutrition: targets, candidates, greedy meals, day totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Activity factors; goal -> (energy factor, protein, carbohydrate, fat shares); meals' shares.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "very_active": 1.9}
GOALS = {"lose": (0.85, 0.35, 0.35, 0.30), "gain": (1.10, 0.25, 0.50, 0.25), "muscle": (1.15, 0.35, 0.45, 0.20), "maintain": (1.0, 0.25, 0.45, 0.30)}
MEALS = {"breakfast": 0.25, "lunch": 0.35, "dinner": 0.30, "snacks": 0.10}


def _case(col: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def valid_profile() -> Column:
    return F.col("age").between(18, 100) & F.col("height_cm").between(120, 250) & F.col("weight_kg").between(40, 200)


def daily_targets(profiles: DataFrame) -> DataFrame:
    """profiles (gender, age, height_cm, weight_kg, activity, goal, ...) with bmr, tdee, calories,
    protein, carbs, fat: revised Harris-Benedict, factor of the activity, shares of the goal."""
    w, h, a = F.col("weight_kg"), F.col("height_cm"), F.col("age")
    bmr = F.when(F.col("gender") == "male", 88.362 + 13.397 * w + 4.799 * h - 5.677 * a).otherwise(447.593 + 9.247 * w + 3.098 * h - 4.330 * a)
    tdee = F.col("bmr") * _case(F.col("activity"), ACTIVITY, 1.2)
    part = lambda i: _case(F.col("goal"), {k: v[i] for k, v in GOALS.items()}, GOALS["maintain"][i])
    out = profiles.withColumn("bmr", bmr).withColumn("tdee", tdee).withColumn("__kcal", F.col("tdee") * part(0))
    for name, i, per in (("protein", 1, 4), ("carbs", 2, 4), ("fat", 3, 9)):
        out = out.withColumn(name, half_up(F.col("__kcal") * part(i) / per))
    return out.withColumn("calories", half_up(F.col("__kcal"))).drop("__kcal")


def meal_targets(targets: DataFrame) -> DataFrame:
    """One row a profile and meal, with meal_calories (and macros) at the meal's share."""
    share = F.explode(F.array(*(F.struct(F.lit(m).alias("meal"), F.lit(s).alias("share")) for m, s in MEALS.items())))
    out = targets.withColumn("__m", share).select(*targets.columns, F.col("__m.meal").alias("meal"), F.col("__m.share").alias("__share"))
    for name in ("calories", "protein", "carbs", "fat"):
        out = out.withColumn(f"meal_{name}", half_up(F.col(name) * F.col("__share")))
    return out.drop("__share")


def candidates(foods: DataFrame, target: float, category: str | None = None, used: DataFrame | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """foods (food_id, title, category, calories, protein, image): unused, without an excluded word in
    the title, of the category, within 30 % of the target, with an image, over 50 kcal and with protein."""
    ok = F.col("calories").between(target * 0.7, target * 1.3) & (F.col("calories") > 50) & (F.col("protein") > 0) & (F.coalesce("image", F.lit("")) != "")
    for word in excluded:
        ok = ok & ~F.lower("title").contains(word.lower())
    if category:
        ok = ok & (F.lower("category") == category.lower())
    out = foods.filter(ok)
    return out.join(used.select("food_id"), "food_id", "left_anti") if used is not None else out


def with_fallback(first: DataFrame, second: DataFrame, least: int = 10) -> DataFrame:
    """first, and where it has fewer than `least` rows the rows of second that aren't in it."""
    few = first.agg((F.count(F.lit(1)) < least).alias("__few"))
    more = second.join(first.select("food_id"), "food_id", "left_anti").crossJoin(F.broadcast(few)).filter("__few").drop("__few")
    return first.unionByName(more)


def greedy_pick(items: Column, target: Column, most: int = 3) -> Column:
    """items: array of (d, food_id, calories), nearest the target first -> the picked ones: in order,
    skipping what takes the sum over 130 %, until it is at 90 % or `most` are picked."""
    zero = F.struct(F.array().cast("array<bigint>").alias("picked"), F.lit(0.0).alias("total"))

    def step(state, x):
        fits = (F.size(state["picked"]) < most) & (state["total"] < target * 0.9) & ((state["total"] + x["calories"] <= target * 1.3) | (F.size(state["picked"]) == 0) & (state["total"] + x["calories"] <= target * 1.3))
        return F.when(fits, F.struct(F.array_append(state["picked"], x["food_id"].cast("bigint")).alias("picked"), (state["total"] + x["calories"]).alias("total"))).otherwise(state)

    return F.aggregate(items, zero, step)


def plan_meal(foods: DataFrame, target: float, keep: int = 50, most: int = 3) -> DataFrame:
    """One row: picked (food ids), total, of the `keep` foods nearest the target."""
    near = foods.select(F.abs(F.col("calories") - target).alias("d"), F.col("food_id"), F.col("calories").cast("double").alias("calories")).orderBy("d", "food_id").limit(keep)
    items = near.agg(F.array_sort(F.collect_list(F.struct("d", "food_id", "calories"))).alias("items"))  # at most `keep`
    return items.select(greedy_pick(F.col("items"), F.lit(float(target)), most).alias("s")).select("s.picked", "s.total")


def plan_day(foods: DataFrame, calories: float, most: int = 3) -> DataFrame:
    """(meal, food_id): meals in order, a food once a day. Each meal's picks, `most` ids at most, are told
    to the next one as values, so plans don't nest."""
    rows, used = [], []
    for meal, share in MEALS.items():
        target = float(calories * share)
        pool = candidates(foods.filter(~F.col("food_id").isin(used)) if used else foods, target)
        picked = plan_meal(pool, target, most=most).first()["picked"] or []
        rows += [(meal, i) for i in picked]
        used += picked
    return foods.sparkSession.createDataFrame(rows, "meal string, food_id long")


def regenerate_score(target_calories: float) -> Column:
    """Preference of a food when a meal is planned again: near the target, rich in protein, light, lean."""
    per = F.when(F.col("calories") > 0, F.col("protein") / F.col("calories")).otherwise(0.0)
    return 2 * (1000 - F.abs(F.col("calories") - target_calories)) + 5000 * per + 1.5 * (2000 - F.col("calories")) + 10 * (100 - F.col("fat"))


def adjusted_target(target: Column, actual: Column) -> Column:
    """What a meal is planned for again: 0.8 of the target if it was over 115 %, 1.2 if under 85 %."""
    ratio = F.when(target > 0, actual / target).otherwise(0.0)
    return F.when(ratio > 1.15, target * 0.8).when(ratio < 0.85, target * 1.2).otherwise(target)


def day_totals(plan: DataFrame, foods: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c in ("calories", "protein", "carbs", "fat") if c in foods.columns]
    return plan.join(foods, "food_id").groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in names))


def status(actual: Column, target: Column) -> Column:
    ratio = actual / target * 100
    return F.when(ratio < 85, "under").when(ratio > 115, "over").otherwise("good")


# -- day plans of a whole table of profiles --------------------------------------------------------

#: Categories of a meal, words that a meal's titles must not hold, and words of titles and keywords that
#: stand in where a meal has fewer than FEW foods by category.
MEAL_CATEGORIES = {"breakfast": ("breakfast", "brunch"), "lunch": ("lunch",), "dinner": ("dinner", "main dish", "main course"), "snacks": ("snack", "appetizer", "dessert")}
MEAL_EXCLUDED = {
    "breakfast": ("dinner", "lunch", "kabob", "kabab", "bbq", "barbecue", "grilled chicken", "roast", "casserole", "steak", "curry", "pasta", "ribs", "brisket"),
    "lunch": (),
    "dinner": ("breakfast", "brunch", "cereal", "oatmeal"),
    "snacks": ("breakfast", "dinner", "lunch", "main"),
}
MEAL_KEYWORDS = {
    "breakfast": ("morning", "cereal", "pancake", "waffle", "egg", "oatmeal", "smoothie", "french toast", "bagel", "muffin", "toast", "bacon", "sausage", "hash brown", "crepe", "omelet", "scramble", "breakfast burrito"),
    "lunch": ("sandwich", "salad", "soup", "wrap", "burger", "pizza"),
    "dinner": ("entree", "casserole", "roast", "steak", "chicken breast", "pasta", "curry", "stir fry", "grilled"),
    "snacks": ("bar", "bite", "cookie", "brownie", "cake", "pie", "chips", "dip"),
}
FEW = 10
#: Calorie buckets a kcal: targets, and 0.8 or 1.2 of them, are multiples of a fifth and so never inside a bucket.
PER_KCAL = 5
_NEAR = "array<struct<food_id:bigint,calories:double,score:double>>"
_LISTS = f"meal string, protein boolean, light boolean, lean boolean, target double, own {_NEAR}, more {_NEAR}"


def eligible(foods: DataFrame, among=tuple(MEALS)) -> DataFrame:
    """foods (food_id, title, category, keywords, calories, protein, fat, image) -> a row for each meal (of those
    asked) that a food may serve: meal, own (by its category, else by a keyword), food_id, calories, protein, fat."""
    types = dict(foods.dtypes)
    listed = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")) if types[c].startswith("array") else F.array(c), lambda x: F.lower(x)) if c in types else F.array().cast("array<string>")
    title = F.lower(F.coalesce("title", F.lit("")))
    holds = lambda text, words: F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    meals = []
    for meal, names in ((m, MEAL_CATEGORIES[m]) for m in among):
        own = F.coalesce(F.arrays_overlap(listed("category"), F.array(*map(F.lit, names))), F.lit(False))
        word = holds(title, MEAL_KEYWORDS[meal]) | holds(F.array_join(listed("keywords"), "\n"), MEAL_KEYWORDS[meal])
        meals.append(F.when((own | word) & ~holds(title, MEAL_EXCLUDED[meal]), F.struct(F.lit(meal).alias("meal"), own.alias("own"))))
    sound = foods.filter((F.col("calories") > 50) & (F.col("protein") > 0) & (F.coalesce("image", F.lit("")) != ""))
    rows = sound.select("food_id", F.col("calories").cast("double").alias("calories"), F.col("protein").cast("double").alias("protein"), F.col("fat").cast("double").alias("fat"), F.explode(F.array_compact(F.array(*meals))).alias("m"))
    return rows.select("m.meal", "m.own", "food_id", "calories", "protein", "fat")


def preference(protein: Column, light: Column, lean: Column) -> Column:
    """What wishes add to a food's score: rich in protein, light, lean."""
    dense = F.col("protein") / F.when(F.col("calories") > 0, F.col("calories")).otherwise(1.0)
    return F.when(protein, dense * 5000).otherwise(0.0) + F.when(light, (2000 - F.col("calories")) * 1.5).otherwise(0.0) + F.when(lean, (100 - F.col("fat")) * 10).otherwise(0.0)


#: Rows of eligible foods that a task gathers before it drops those that can't be among the best.
GATHERED = 200_000


def _best(n_wishes: int, keep: int):
    def marked(foods):
        """foods with `wishes`: a bit for each wish for which a food is among its bucket's `keep` best of a side; the others go."""
        import numpy as np

        foods = foods.drop_duplicates(["meal", "own", "bucket", "food_id", "calories", *(f"extra{i}" for i in range(n_wishes))])
        group = foods.groupby(["meal", "own", "bucket"], sort=False).ngroup().to_numpy()
        ids, calories, bits = foods["food_id"].to_numpy(), foods["calories"].to_numpy(), np.zeros(len(foods), np.int64)
        for i in range(n_wishes):
            extra = foods[f"extra{i}"].to_numpy()
            for side in (1, -1):
                order = np.lexsort((ids, -(side * 2 * calories + extra), group))
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
                bits[order[rank < keep]] |= 1 << i
        return foods.assign(wishes=bits)[bits > 0]

    def run(batches):
        import pandas as pd

        held, n, most = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= most:
                held = [marked(pd.concat(held, ignore_index=True))]
                n = len(held[0])
                most = max(GATHERED, 2 * n)
        if n:
            yield marked(pd.concat(held, ignore_index=True))

    return run


def shortlist(rows: DataFrame, wishes: list[tuple[bool, bool, bool]], keep: int) -> DataFrame:
    """The eligible foods that can be among the `keep` best for any target, whatever the number of foods.

    Of the foods of one calorie bucket a target has all on one side, and on one side their order by score doesn't depend on
    the target. So a meal's bucket needs its `keep` best for each side and wish. Each task that reads foods finds these of
    its own, holding no more rows than GATHERED or twice what stays; a bucket's foods then meet and are ranked again, so
    a bucket that holds a third of all foods is a few rows a task.
    """
    extras = [preference(F.lit(p), F.lit(l), F.lit(n)).cast("double").alias(f"extra{i}") for i, (p, l, n) in enumerate(wishes)]  # noqa: E741
    each = rows.select("meal", "own", F.floor(F.col("calories") * PER_KCAL).alias("bucket"), "food_id", "calories", *extras, F.lit(0).cast("long").alias("wishes"))
    best = _best(len(wishes), keep)
    met = each.mapInPandas(best, each.schema).repartition("meal", "own", "bucket").mapInPandas(best, each.schema)
    wish = lambda i, p, l, n: F.when(F.col("wishes").bitwiseAND(1 << i) != 0, F.struct(F.lit(p).alias("protein"), F.lit(l).alias("light"), F.lit(n).alias("lean"), F.col(f"extra{i}").alias("extra")))  # noqa: E731, E741
    rows = met.select("meal", "own", "food_id", "calories", F.explode(F.array_compact(F.array(*(wish(i, *w) for i, w in enumerate(wishes))))).alias("w"))
    return rows.select("meal", "w.protein", "w.light", "w.lean", "own", "food_id", "calories", "w.extra")


def _nearest(keep: int):
    def run(foods, wanted):
        import numpy as np
        import pandas as pd

        out = []
        parts = {own: foods[foods["own"] == own].sort_values(["calories", "food_id"]) for own in (True, False)}
        parts = {own: (p["calories"].to_numpy(), p["food_id"].to_numpy(), p["extra"].to_numpy()) for own, p in parts.items()}
        for row in wanted.itertuples(index=False):
            found = []
            for own in (True, False):
                calories, ids, extra = parts[own]
                a, b = np.searchsorted(calories, row.target * 0.7, "left"), np.searchsorted(calories, row.target * 1.3, "right")
                score = 2 * (1000 - np.abs(calories[a:b] - row.target)) + extra[a:b]
                best = np.lexsort((ids[a:b], -score))[:keep]
                found.append([{"food_id": int(ids[a + i]), "calories": float(calories[a + i]), "score": float(score[i])} for i in best])
            out.append((row.meal, row.protein, row.light, row.lean, row.target, *found))
        return pd.DataFrame(out, columns=["meal", "protein", "light", "lean", "target", "own", "more"])

    return run


def nearest(foods: DataFrame, wanted: DataFrame, wishes: list[tuple[bool, bool, bool]], keep: int, among=tuple(MEALS)) -> DataFrame:
    """wanted (meal, of `among`, protein, light, lean, target), distinct -> with own and more: the `keep` best foods within 30 % of the
    target, of the meal's category and by its keywords. A task has one meal and wish: the shortlist, whose size
    is bound by the number of buckets, and the different targets."""
    by = ["meal", "protein", "light", "lean"]
    return shortlist(eligible(foods, among), wishes, keep).groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(_nearest(keep), _LISTS)


def _picked(lists: Column, target: Column, used: Column, most: int) -> Column:
    """The picked ids of one meal: unused foods by score, with those by keyword where fewer than FEW are of the category."""
    free = lambda foods: F.filter(foods, lambda x: ~F.array_contains(used, x["food_id"]))
    as_items = lambda foods: F.transform(foods, lambda x: F.struct((-x["score"]).alias("d"), x["food_id"].alias("food_id"), x["calories"].alias("calories")))
    own = free(lists["own"])
    pool = F.array_sort(as_items(F.when(F.size(own) < FEW, F.concat(own, free(lists["more"]))).otherwise(own)))
    return greedy_pick(pool, target, most)["picked"]


def plan_days(profiles: DataFrame, foods: DataFrame, most: int = 3) -> DataFrame:
    """profiles with `calories` (whole numbers a day) -> their columns with plan: an array of (meal, target, picked food ids).

    Meals are planned in order, each without the foods of those before. A plan depends on the day's calories alone, so
    each different number of calories is planned once and profiles join its plan. Foods are read once; no pairs
    of profiles and foods are made. A profile with null calories, or without any fitting food, has meals without picks.
    """
    order = {m: i for i, m in enumerate(MEALS)}
    days = profiles.select(F.col("calories").alias("__day")).filter(F.col("calories").isNotNull()).distinct()
    share = F.explode(F.array(*(F.struct(F.lit(order[m]).alias("nth"), F.lit(m).alias("meal"), F.lit(s).alias("share")) for m, s in MEALS.items())))
    meals = days.select("__day", share.alias("m")).select("__day", "m.nth", "m.meal", half_up(F.col("__day") * F.col("m.share")).cast("double").alias("target"))
    no = F.lit(False)
    wanted = meals.select("meal", no.alias("protein"), no.alias("light"), no.alias("lean"), "target").distinct()
    lists = nearest(foods, wanted, [(False, False, False)], FEW + most * len(MEALS)).select("meal", "target", "own", "more")
    none = F.array().cast(_NEAR)
    met = meals.join(lists, ["meal", "target"], "left").withColumns({c: F.coalesce(c, none) for c in ("own", "more")})
    sets = met.groupBy("__day").agg(F.array_sort(F.collect_list(F.struct("nth", "meal", "target", "own", "more"))).alias("meals"))  # four each
    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<meal:string,target:double,picked:array<bigint>>>").alias("plan"))

    def step(state, m):
        picked = _picked(m, m["target"], state["used"], most)
        row = F.struct(m["meal"].alias("meal"), m["target"].alias("target"), picked.alias("picked"))
        return F.struct(F.concat(state["used"], picked).alias("used"), F.array_append(state["plan"], row).alias("plan"))

    plans = sets.select("__day", F.aggregate("meals", zero, step)["plan"].alias("plan"))
    return profiles.join(plans, F.col("calories") == F.col("__day"), "left").drop("__day")


def regenerate_meals(plans: DataFrame, foods: DataFrame, meal: str, id_col: str, most: int = 3) -> DataFrame:
    """plans (id, calories, protein, fat, plan: an array of (meal, target, picked)) -> id, meal, target, picked: one
    meal planned again without any of the day's foods.

    The day's totals say how: over 115 % of the calories it is planned for 0.8 of its target and prefers light foods, under 85 %
    for 1.2; under 85 % of the protein it prefers rich foods, over 115 % of the fat lean ones. Different days, wishes
    and targets are looked up once, and plans join their day's answer. An unknown food counts nothing; repeated ids are rows each.
    """
    key = ["calories", "protein", "fat", "plan"]
    days = plans.select(*key).filter(F.col("plan").isNotNull()).distinct()
    eaten = days.select(F.explode(F.flatten(F.transform("plan", lambda m: m["picked"]))).alias("food_id")).distinct()
    facts = foods.select("food_id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in ("calories", "protein", "fat"))).join(eaten, "food_id", "left_semi")
    sums = days.select("plan").distinct().select("plan", F.explode_outer(F.flatten(F.transform("plan", lambda m: m["picked"]))).alias("food_id")).join(facts, "food_id", "left")
    sums = sums.groupBy("plan").agg(*(F.coalesce(F.sum(f"__{c}"), F.lit(0.0)).alias(f"__{c}") for c in ("calories", "protein", "fat")))
    told = days.join(sums, "plan")
    ratio = {c: F.when(F.col(c) > 0, F.col(f"__{c}") / F.col(c)).otherwise(0.0) for c in ("calories", "protein", "fat")}
    own = F.element_at(F.filter("plan", lambda m: m["meal"] == meal), 1)["target"]
    change = F.when(ratio["calories"] > 1.15, 0.8).when(ratio["calories"] < 0.85, 1.2).otherwise(1.0)
    told = told.select(F.struct(*key).alias("__day"), F.flatten(F.transform("plan", lambda m: m["picked"])).alias("used"), F.lit(meal).alias("meal"), F.round(own * change, 1).alias("target"), (ratio["protein"] < 0.85).alias("protein"), (ratio["calories"] > 1.15).alias("light"), (ratio["fat"] > 1.15).alias("lean"))
    by = ["meal", "protein", "light", "lean", "target"]
    wishes = [(p, l, n) for p in (False, True) for l in (False, True) for n in (False, True)]  # noqa: E741
    lists = nearest(foods, told.select(*by).filter(F.col("target").isNotNull()).distinct(), wishes, FEW + most * len(MEALS), (meal,))
    none = F.array().cast(_NEAR)
    met = told.join(lists, by, "left").withColumns({c: F.coalesce(c, none) for c in ("own", "more")})
    found = met.select("__day", *by, _picked(F.struct("own", "more"), F.col("target"), F.col("used"), most).alias("picked"))
    return plans.select(F.col(id_col), F.struct(*key).alias("__day")).join(found, "__day").select(id_col, "meal", "target", "protein", "light", "lean", "picked")
