"""Day plans of many profiles against a loop over each."""

import random

import pytest

from larder.operators import planner as p

FOODS = "food_id long, title string, category string, keywords array<string>, calories double, protein double, fat double, image string"
PLANS = "id long, calories long, protein long, fat long"


def menu(seed, n):
    r = random.Random(seed)
    cats = ["Breakfast", "brunch", "lunch", "dinner", "Main Dish", "snack", "dessert", "other", None]
    return [(i, r.choice(["Red Toast", "pasta", "Cake bar", "plain", "dinner roast", "", None]), r.choice(cats), r.choice([None, [], ["Egg"], ["soup", "x"]]), float(r.choice([r.randint(40, 1500), 500, r.randint(200, 800) + 0.25])), float(r.randint(0, 30)), float(r.randint(0, 60)), r.choice(["x.jpg", "x.jpg", "", None])) for i in range(n)]


def candidates(foods, meal, target, used):
    def ok(f):
        title = (f[1] or "").lower()
        return f[0] not in used and not any(w in title for w in p.MEAL_EXCLUDED[meal]) and target * 0.7 <= f[4] <= target * 1.3 and f[7] and f[4] > 50 and f[5] > 0

    own = [f for f in foods if ok(f) and (f[2] or "").lower() in p.MEAL_CATEGORIES[meal]]
    if len(own) < 10:
        own += [f for f in foods if ok(f) and f not in own and any(w in (f[1] or "").lower() or any(w in k.lower() for k in f[3] or []) for w in p.MEAL_KEYWORDS[meal])]
    return own


def pick(foods, target, score):
    picked, total = [], 0.0
    for f in sorted(foods, key=lambda f: (-score(f), f[0])):
        if len(picked) >= 3:
            break
        if picked and total + f[4] > target * 1.3:
            continue
        picked.append(f[0])
        total += f[4]
        if target * 0.9 <= total <= target * 1.2:
            break
    return picked


def plan(foods, day):
    used, out = [], []
    for meal, share in p.MEALS.items():
        target = float(int(day * share + 0.5))
        got = pick(candidates(foods, meal, target, used), target, lambda f, t=target: 2 * (1000 - abs(f[4] - t)))
        used += got
        out.append((meal, target, got))
    return out


def again(foods, row, meals, meal):
    _, day, protein, fat = row
    eaten = [f for f in foods for m in meals if f[0] in m[2]]
    kcal, prot, fats = (sum(f[i] for f in eaten) / goal if goal > 0 else 0.0 for i, goal in ((4, day), (5, protein), (6, fat)))
    target = round(next(m[1] for m in meals if m[0] == meal) * (0.8 if kcal > 1.15 else 1.2 if kcal < 0.85 else 1.0), 1)
    score = lambda f: 2 * (1000 - abs(f[4] - target)) + (f[5] / f[4] * 5000 if prot < 0.85 else 0) + ((2000 - f[4]) * 1.5 if kcal > 1.15 else 0) + ((100 - f[6]) * 10 if fats > 1.15 else 0)
    return target, pick(candidates(foods, meal, target, [i for m in meals for i in m[2]]), target, score)


@pytest.mark.parametrize("n", [25, 1500])
def test_plans_are_the_loops(spark, n):
    foods = menu(n, n)
    r = random.Random(1)
    rows = [(i, r.choice([1800, r.randint(900, 3500)]), r.randint(0, 300), r.randint(0, 120)) for i in range(60)] + [(60, None, 1, 1)]
    profiles, table = spark.createDataFrame(rows, PLANS), spark.createDataFrame(foods, FOODS).repartition(3)
    plans = p.plan_days(profiles, table).cache()
    got = {x.id: [(m.meal, m.target, m.picked) for m in x.plan] if x.plan else None for x in plans.collect()}
    assert got == {row[0]: plan(foods, row[1]) if row[1] else None for row in rows}
    assert any(m[2] for m in got[0])
    for meal in ("dinner", "breakfast"):
        new = {x.id: (x.target, x.picked) for x in p.regenerate_meals(plans, table, meal, "id").collect()}
        assert new == {row[0]: again(foods, row, got[row[0]], meal) for row in rows if row[1]}


def test_no_profiles_or_foods(spark):
    profiles, foods = spark.createDataFrame([(1, 2000, 1, 1)], PLANS), spark.createDataFrame([], FOODS)
    assert [(m.meal, m.picked) for m in p.plan_days(profiles, foods).first().plan] == [(m, []) for m in p.MEALS]
    assert p.plan_days(profiles.limit(0), foods).count() == 0


def test_shortlist_in_bounded_memory(spark, monkeypatch):
    """Each bucket's best for each side and wish, a food that is listed often once; nothing is sorted before portions are cut down."""
    monkeypatch.setattr(p, "GATHERED", 40)
    r = random.Random(5)
    wishes, keep = [(False, False, False), (True, False, True)], 3
    rows = [("lunch", r.random() < 0.5, i, float(r.choice([300, 300, 300.1, 500])), float(r.randint(1, 9)), float(r.randint(0, 9))) for i in range(400)] + [("lunch", True, 1000, 700.0, 5.0, 5.0)] * 30 + [("lunch", True, 1001, 700.0, 5.0, 5.0), ("lunch", True, 1002, 700.0, 5.0, None)]
    foods = spark.createDataFrame(rows, "meal string, own boolean, food_id long, calories double, protein double, fat double").repartition(2)
    best = p.shortlist(foods, wishes, keep)
    got = {tuple(x) for x in best.select("protein", "lean", "own", "food_id").collect()}
    want = set()
    for rich, _, lean in wishes:
        extra = lambda f: (f[4] / f[3] * 5000 if rich else 0.0) + (((100 - f[5]) * 10 if f[5] is not None else float("-inf")) if lean else 0.0)  # noqa: B023, E731
        for key in {(f[1], int(f[3] * 5)) for f in rows}:
            own = sorted({f for f in rows if (f[1], int(f[3] * 5)) == key}, key=lambda f: f[2])
            for side in (1, -1):
                want |= {(rich, lean, f[1], f[2]) for f in sorted(own, key=lambda f: -(side * 2 * f[3] + extra(f)))[:keep]}
    assert got == want
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()


def test_profiles_without_goals_keep_their_answer(spark):
    foods = spark.createDataFrame(menu(7, 300), FOODS)
    profiles = spark.createDataFrame([(1, 2000, None, 50), (1, 2000, None, 50), (2, 2000, 100, None), (3, None, 1, 1)], PLANS)
    got = sorted((x.id, x.protein, x.lean) for x in p.regenerate_meals(p.plan_days(profiles, foods), foods, "dinner", "id").collect())
    assert [g[0] for g in got] == [1, 1, 2] and got[0][1] is True and got[2][2] is False
