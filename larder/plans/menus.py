"""Queries of day plans for all customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import planner
from .registry import _TARGETS, _profiles, query, table

_CATEGORIES = ["Breakfast", "lunch", "dinner", "snack", "dessert", "main dish", "other", "brunch"]
_KEYWORDS = ["egg", "salad", "steak", "cookie", "x", "pizza"]
_EXCLUDED = {"breakfast": ["dinner", "lunch", "steak"], "lunch": [], "dinner": ["breakfast", "brunch"], "snacks": ["breakfast", "dinner", "lunch", "main"]}


def _menu(spark, sf_dir):
    """Parts as foods: calories, nutrients, category and keyword from key and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, n: F.element_at(text.literals(values), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("food_id"), F.concat(F.col("p_name"), F.when(k % 11 == 0, " dinner lunch").otherwise("")).alias("title"), pick(_CATEGORIES, k % 13).alias("category"), F.array(pick(_KEYWORDS, k % 7)).alias("keywords"),
        (40 + (k * 37) % 900).alias("calories"), (size % 30).alias("protein"), (size % 40).alias("carbs"), (size % 20).alias("fat"), F.when(k % 17 != 0, "x.jpg").alias("image"),
    )


def _contains(col: str, words) -> str:
    return "(" + (" OR ".join(f"contains({col}, '{w}')" for w in words) or "false") + ")"


def _one_of(n: str, values) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + ({n}) % {len(values)}]"


_FOODS = f"""foods AS (SELECT p_partkey AS food_id, lower(p_name || CASE WHEN p_partkey % 11 = 0 THEN ' dinner lunch' ELSE '' END) AS title, lower({_one_of("p_partkey % 13", _CATEGORIES)}) AS category, {_one_of("p_partkey % 7", _KEYWORDS)} AS word,
(40 + (p_partkey * 37) % 900)::DOUBLE AS calories, p_size % 30 AS protein, p_size % 20 AS fat FROM part WHERE p_partkey % 17 <> 0 AND 40 + (p_partkey * 37) % 900 > 50 AND p_size % 30 > 0)"""


def _step(meal: str, share: float, before: list[str]) -> str:
    """CTE (day, target, food_id): the food nearest a meal's target; a second never fits beside one of 70 % of it."""
    own = "category IN (" + ", ".join(f"'{c}'" for c in planner.MEAL_CATEGORIES[meal]) + ")"
    word = f"({_contains('title', planner.MEAL_KEYWORDS[meal])} OR {_contains('word', planner.MEAL_KEYWORDS[meal])})"
    used = " AND ".join(f"food_id IS DISTINCT FROM {b}.food_id" for b in before) or "true"
    joins = " ".join(f"JOIN {b} ON {b}.day = d.day" for b in before)
    return f"""{meal}_all AS (SELECT d.day, d.target, foods.food_id, {own} AS own, abs(calories - d.target) AS away, count(*) FILTER ({own}) OVER (PARTITION BY d.day) AS n_own
  FROM (SELECT DISTINCT calories AS day, floor(calories * {share}::DOUBLE + 0.5)::DOUBLE AS target FROM d) d {joins} JOIN foods ON calories BETWEEN d.target * 0.7::DOUBLE AND d.target * 1.3::DOUBLE AND ({own} OR {word}) AND NOT {_contains('title', planner.MEAL_EXCLUDED[meal])} AND {used.replace('food_id IS', 'foods.food_id IS')}),
{meal} AS MATERIALIZED (SELECT day, target, p.food_id FROM (SELECT DISTINCT calories AS day, floor(calories * {share}::DOUBLE + 0.5)::DOUBLE AS target FROM d) LEFT JOIN (SELECT day, food_id FROM {meal}_all WHERE own OR n_own < 10 QUALIFY row_number() OVER (PARTITION BY day ORDER BY away, food_id) = 1) p USING (day))"""


_STEPS = ",\n".join(_step(m, s, list(planner.MEALS)[:i]) for i, (m, s) in enumerate(planner.MEALS.items()))
_PLANS = f"{_TARGETS}, {_FOODS}, {_STEPS}"


@query(f"{_PLANS} SELECT c_custkey, meal, target, food_id FROM d JOIN (" + " UNION ALL ".join(f"SELECT day, '{m}' AS meal, target, food_id FROM {m}" for m in planner.MEALS) + ") x ON x.day = d.calories")
def day_plans(spark, sf_dir):
    """Four meals for each customer: one row a picked food, or one without a food where none fits."""
    plans = planner.plan_days(planner.daily_targets(_profiles(spark, sf_dir)), _menu(spark, sf_dir))
    rows = plans.select("c_custkey", F.explode("plan").alias("m"))
    return rows.select("c_custkey", "m.meal", "m.target", F.explode_outer("m.picked").alias("food_id"))


_SUMS = ", ".join(f"coalesce(b.{c}, 0) + coalesce(l.{c}, 0) + coalesce(n.{c}, 0) + coalesce(s.{c}, 0) AS {c}" for c in ("calories", "protein", "fat"))
_AGAIN = f"""{_PLANS},
e AS (SELECT c_custkey, d.calories AS goal, d.protein AS goal_p, d.fat AS goal_f, dinner.target AS own, breakfast.food_id AS f1, lunch.food_id AS f2, dinner.food_id AS f3, snacks.food_id AS f4, {_SUMS}
  FROM d JOIN breakfast ON breakfast.day = d.calories JOIN lunch ON lunch.day = d.calories JOIN dinner ON dinner.day = d.calories JOIN snacks ON snacks.day = d.calories
  LEFT JOIN foods b ON b.food_id = breakfast.food_id LEFT JOIN foods l ON l.food_id = lunch.food_id LEFT JOIN foods n ON n.food_id = dinner.food_id LEFT JOIN foods s ON s.food_id = snacks.food_id),
w AS (SELECT *, round(own * CASE WHEN calories / goal > 1.15 THEN 0.8 WHEN calories / goal < 0.85 THEN 1.2 ELSE 1.0 END::DOUBLE, 1) AS target, protein / goal_p < 0.85 AS rich, calories / goal > 1.15 AS light, fat / goal_f > 1.15 AS lean FROM e),
x AS (SELECT w.*, foods.food_id AS id, foods.category IN ('dinner', 'main dish', 'main course') AS is_own, 2 * (1000 - abs(foods.calories - target)) + CASE WHEN rich THEN foods.protein / foods.calories * 5000 ELSE 0 END + CASE WHEN light THEN (2000 - foods.calories) * 1.5::DOUBLE ELSE 0 END + CASE WHEN lean THEN (100 - foods.fat) * 10 ELSE 0 END AS score
  FROM w JOIN foods ON foods.calories BETWEEN target * 0.7::DOUBLE AND target * 1.3::DOUBLE AND (category IN ('dinner', 'main dish', 'main course') OR {_contains('title', planner.MEAL_KEYWORDS['dinner'])} OR {_contains('word', planner.MEAL_KEYWORDS['dinner'])})
   AND NOT {_contains('title', planner.MEAL_EXCLUDED['dinner'])} AND food_id IS DISTINCT FROM f1 AND food_id IS DISTINCT FROM f2 AND food_id IS DISTINCT FROM f3 AND food_id IS DISTINCT FROM f4),
y AS (SELECT c_custkey, id FROM (SELECT *, count(*) FILTER (is_own) OVER (PARTITION BY c_custkey) AS n_own FROM x) WHERE is_own OR n_own < 10 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(score, 6) DESC, id) = 1)
SELECT c_custkey, target, rich AS protein, light, lean, id AS food_id FROM w LEFT JOIN y USING (c_custkey)"""


@query(_AGAIN)
def dinners_again(spark, sf_dir):
    """Every customer's dinner planned again, by what the day has too little or too much of."""
    menu = _menu(spark, sf_dir)
    plans = planner.plan_days(planner.daily_targets(_profiles(spark, sf_dir)), menu)
    again = planner.regenerate_meals(plans, menu, "dinner", "c_custkey")
    return again.select("c_custkey", "target", "protein", "light", "lean", F.explode_outer("picked").alias("food_id"))


