"""Random small frames against expected values in plain Python, from the null,
tie and bucket rules (SURVEY 2.12)."""

from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stagelight.operators.filters import BASE_COLUMNS, Filters, apply_filters
from stagelight.plans import analyses as A

from .conftest import base_rows, tp_rows

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

genders = st.sampled_from(["Male", "Female", None])
cities = st.sampled_from(["a", "b", "c", None])
days = st.integers(min_value=0, max_value=400)
amounts = st.one_of(st.none(), st.integers(min_value=0, max_value=500))
ages = st.one_of(st.none(), st.integers(min_value=0, max_value=110))

base_row = st.fixed_dictionaries({
    "day": days, "Amount": amounts, "Customer_Age": ages, "Customer_Gender": genders, "City": cities})


START = dt.datetime(2024, 1, 1)
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def to_base(spark, rows):
    recs = [{**{k: r[k] for k in ("Amount", "Customer_Age", "Customer_Gender", "City")},
             "Order_Date": START + dt.timedelta(days=r["day"])} for r in rows]
    return base_rows(spark, recs), recs


def wanted(row, f: Filters) -> bool:
    """N5, N11: both bounds inclusive, a null value fails a range, a null pick takes nulls."""
    ranges = []
    if f.start and f.end:
        ranges.append((row["Order_Date"], dt.datetime.fromisoformat(f.start), dt.datetime.fromisoformat(f.end)))
    if f.age:
        ranges.append((row["Customer_Age"], *f.age))
    picks = [(row["City"], f.cities), (row["Customer_Gender"], f.genders)]
    return (all(v is not None and lo <= v <= hi for v, lo, hi in ranges)
            and all(not chosen or v in chosen for v, chosen in picks))


filters = st.builds(
    Filters,
    start=st.sampled_from([None, "2024-02-01"]), end=st.sampled_from([None, "2024-10-15"]),
    age=st.sampled_from([None, (10, 60), (0, 110)]),
    cities=st.sampled_from([None, ("a",), ("a", None), ("b", "c")]),
    genders=st.sampled_from([None, ("Male",), ("Female", None)]))


@SETTINGS
@given(rows=st.lists(base_row, min_size=0, max_size=25), f=filters)
def test_filters(spark, rows, f):
    df, recs = to_base(spark, rows)
    assert apply_filters(df, f, BASE_COLUMNS).count() == sum(wanted(r, f) for r in recs)


@SETTINGS
@given(rows=st.lists(base_row, min_size=1, max_size=25), f=filters)
def test_monthly_growth(spark, rows, f):
    """N2, N4: a month of nulls is 0; growth over 0 or nothing is null."""
    df, recs = to_base(spark, rows)
    sums = defaultdict(int)
    for r in recs:
        if wanted(r, f):
            sums[f"{r['Order_Date']:%Y-%m}"] += r["Amount"] or 0
    expect, last = [], None
    for month in sorted(sums):
        expect.append((month, float(sums[month]), (sums[month] / last - 1) * 100 if last else None))
        last = sums[month]
    got = [(r["Month"], r["Amount"], r["Growth_Rate"]) for r in A.monthly_revenue_growth(df, f).collect()]
    assert [x[:2] for x in got] == [x[:2] for x in expect]
    for (*_, g), (*_, e) in zip(got, expect):
        assert g == e or abs(g - e) <= 1e-9 * max(1, abs(e))


@SETTINGS
@given(rows=st.lists(base_row, min_size=0, max_size=25))
def test_gender_counts(spark, rows):
    df, recs = to_base(spark, rows)
    expect = Counter(r["Customer_Gender"] for r in recs if r["Customer_Gender"] is not None)
    assert {r[0]: r[1] for r in A.gender_distribution(df).collect()} == expect


teacher_row = st.fixed_dictionaries({
    "t": st.integers(min_value=0, max_value=13), "s": st.one_of(st.none(), st.integers(0, 30)),
    "age": ages, "day": st.one_of(st.none(), days)})


def to_tp(spark, rows):
    recs = [{"Teacher_ID": r["t"], "Teacher_Name": f"T{r['t']:02d}" if r["t"] < 12 else "Unknown",
             "Student_ID": r["s"], "Student_Age": r["age"],
             "Course_Date": None if r["day"] is None else START + dt.timedelta(days=r["day"])} for r in rows]
    return tp_rows(spark, recs), recs


def leading(recs) -> list[tuple[str, int]]:
    """T3, N9: up to ten named teachers all stay; of more, the five with most rows, ties by name."""
    ordered = sorted(Counter(r["Teacher_Name"] for r in recs if r["Teacher_Name"] != "Unknown").items(),
                     key=lambda x: (-x[1], x[0]))
    return ordered if len(ordered) <= 10 else ordered[:5]


def age_label(age):
    """N7, N8; fixed values: each label with the highest age it takes, 0 and below in none."""
    for highest, label in ((0, None), (20, "0-20"), (30, "21-30"), (40, "31-40"), (50, "41-50"), (100, "50+")):
        if age is None or age <= highest:
            return label if age is not None else None
    return None


@SETTINGS
@given(rows=st.lists(teacher_row, min_size=0, max_size=60))
def test_conditional_top5(spark, rows):
    df, recs = to_tp(spark, rows)
    assert [(r["Teacher_Name"], r["n"]) for r in A.teacher_top5(df).collect()] == leading(recs)


@SETTINGS
@given(rows=st.lists(teacher_row, min_size=1, max_size=60))
def test_audience(spark, rows):
    df, recs = to_tp(spark, rows)
    students = {(name, label): set() for name, _ in leading(recs) for label in (None, "0-20", "21-30", "31-40", "41-50", "50+")}
    everyone = {name: set() for name, _ in leading(recs)}
    for r in recs:
        if r["Teacher_Name"] in everyone and r["Student_ID"] is not None:
            everyone[r["Teacher_Name"]].add(r["Student_ID"])
            students[r["Teacher_Name"], age_label(r["Student_Age"])].add(r["Student_ID"])
    assert {r[0]: r[1] for r in A.audience_totals(df).collect()} == {k: len(v) for k, v in everyone.items()}
    grid = {(r[0], r[1]): r[2] for r in A.audience_unique_students(df).collect()}
    assert grid == {k: len(v) for k, v in students.items() if k[1]}


@SETTINGS
@given(rows=st.lists(base_row, min_size=1, max_size=30))
def test_heatmap_grid(spark, rows):
    """N6: every weekday of every month that has rows."""
    df, recs = to_base(spark, rows)
    expect = {(d, f"{r['Order_Date']:%Y-%m}"): 0.0 for r in recs for d in DAY_NAMES}
    for r in recs:
        expect[DAY_NAMES[r["Order_Date"].weekday()], f"{r['Order_Date']:%Y-%m}"] += r["Amount"] or 0
    assert {(r["Day_of_Week"], r["Month"]): r["Amount"] for r in A.booking_heatmap(df).collect()} == expect


@SETTINGS
@given(ages_=st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=400)), min_size=1, max_size=30))
def test_histogram_matches_brute_force(spark, ages_):
    df = base_rows(spark, [{"Customer_Age": a} for a in ages_])
    present = [a for a in ages_ if a is not None]
    got = [(r["bin_start"], r["bin_end"], r["n"]) for r in A.age_histogram(df).collect()]
    if not present:
        assert got == []
        return
    lo, hi = min(present), max(present)
    width = next(w for e in range(10) for w in (10 ** e, 2 * 10 ** e, 5 * 10 ** e)
                 if hi // w - lo // w + 1 <= 20)
    counts = {}
    for a in present:
        counts[a // width * width] = counts.get(a // width * width, 0) + 1
    assert got == [(b, b + width, n) for b, n in sorted(counts.items())]
