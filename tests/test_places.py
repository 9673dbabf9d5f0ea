"""The place at the right end of a line, with a small gazetteer."""

import pytest

from cadenza.operators.places import GAZETTEER, peeled

#: name, country code, label, sure
COUNTRIES = [
    ('USA', 'US', 'US', True),
    ('United States', 'US', 'US', True),
    ('Canada', 'CA', 'Canada', True),
    ('Germany', 'DE', 'Germany', True),
    ('France', 'FR', 'France', True),
    ('FR', 'FR', 'France', False),
    ('Georgia', 'GE', 'Georgia', False),
    ('Australia', 'AU', 'Australia', True),
    ('Japan', 'JP', 'Japan', True),
    ('UK', 'GB', 'UK', True),
    ('Netherlands', 'NL', 'Netherlands', True),
]
#: name, country code, region code, label, sure, the city that it says
REGIONS = [
    ('VA', 'US', 'VA', 'VA', True, None),
    ('NY', 'US', 'NY', 'NY', True, None),
    ('New York', 'US', 'NY', 'NY', True, None),
    ('NYC', 'US', 'NY', 'NY', True, 'New York'),
    ('Georgia', 'US', 'GA', 'GA', True, None),
    ('DC', 'US', 'DC', 'DC', True, 'Washington'),
    ('Washington DC', 'US', 'DC', 'DC', True, 'Washington'),
    ('washdc', 'US', 'DC', 'DC', True, 'Washington'),
    ('Pennsylvania', 'US', 'PA', 'PA', True, None),
    ('CA', 'US', 'CA', 'CA', True, None),
    ('WA', 'US', 'WA', 'WA', True, None),
    ('ON', 'CA', '08', 'Ontario', True, None),
    ('Ontario', 'CA', '08', 'Ontario', True, None),
    ('WA', 'AU', '08', 'Western Australia', False, None),
    ('England', 'GB', 'ENG', 'England', True, None),
    ('Bavaria', 'DE', '02', 'Bavaria', True, None),
]
#: name, country code, region code, inhabitants
CITIES = [
    ('Charlottesville', 'US', 'VA', 40000),
    ('New York', 'US', 'NY', 8000000),
    ('Buffalo', 'US', 'NY', 200000),
    ('Atlanta', 'US', 'GA', 400000),
    ('Tbilisi', 'GE', '51', 1000000),
    ('San Francisco', 'US', 'CA', 800000),
    ('Philadelphia', 'US', 'PA', 1500000),
    ('Toronto', 'CA', '08', 2000000),
    ('Ottawa', 'CA', '08', 800000),
    ('Perth', 'AU', '08', 2000000),
    ('London', 'GB', 'ENG', 8000000),
    ('Munich', 'DE', '02', 1000000),
    ('Paris', 'FR', '11', 2000000),
    ('Osaka', 'JP', '32', 2000000),
    ('Amsterdam', 'NL', '07', 700000),
    ('Washington', 'US', 'DC', 600000),
]


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = [("country", n, cc, None, label, sure, None, None) for n, cc, label, sure in COUNTRIES]
    rows += [("region", n, cc, code, label, sure, says, None) for n, cc, code, label, sure, says in REGIONS]
    rows += [("city", n, cc, code, None, True, None, people) for n, cc, code, people in CITIES]
    return spark.createDataFrame([*rows, ("city", "NYC", "US", "NY", "New York", True, None, 8_000_000)], GAZETTEER)


#: line, and city, region, country, what is left of it, venue, confidence
LINES = [
    ("Star Mill Music Hall, Charlottesville VA", ("Charlottesville", "VA", "US", "Star Mill Music Hall", "Star Mill Music Hall", "high")),
    ("Forest Mills, NY @ Forest Mills Stadium", ("Forest Mills", "NY", "US", "", "Forest Mills Stadium", "medium")),
    ("Royal Hall, London", ("London", None, None, "Royal Hall", "Royal Hall", "low")),
    ("The Centre, Toronto, ON", ("Toronto", "Ontario", "Canada", "The Centre", "The Centre", "high")),
    ("Toronto, on", ("Toronto", "Ontario", "Canada", "", "", "high")),
    ("Set on", None),
    ("Paris, FR", ("Paris", None, "France", "", "", "high")),
    ("SBD, FR", None),
    ("THE CELLAR,WASH.D.C. JULY 11,1981", ("Washington", "DC", "US", "THE CELLAR", "THE CELLAR", "high")),
    ("Washington, D.C.", ("Washington", "DC", "US", "", "", "high")),
    ("Stars \u2013 Philadelphia, Pennsylvania, USA", ("Philadelphia", "PA", "US", "", "Stars", "high")),
    ("New York, NY, USA", ("New York", "NY", "US", "", "", "high")),
    ("Buffalo, New York", ("Buffalo", "NY", "US", "", "", "high")),
    ("London, U.K.", ("London", None, "UK", "", "", "high")),
    ("London, England", ("London", "England", "UK", "", "", "high")),
    ("Atlanta, Georgia", ("Atlanta", "GA", "US", "", "", "high")),
    ("Tbilisi, Georgia", ("Tbilisi", None, "Georgia", "", "", "high")),
    ("Ottawa, Ontario (Canada)", ("Ottawa", "Ontario", "Canada", "", "", "high")),
    ("Perth, WA, Australia", ("Perth", "Western Australia", "Australia", "", "", "high")),
    ("East Hampton, NY", ("East Hampton", "NY", "US", "", "", "medium")),
    ("osaka, japan", ("Osaka", None, "Japan", "", "", "high")),
    ("Barn San Francisco CA", ("San Francisco", "CA", "US", "Barn", "Barn", "high")),
    ("Nyc, NY", ("New York", "NY", "US", "", "", "high")),
    ("A  SIDE  TRIO III+  (USA)", None),
    ("SBD", None),
    ("", None),
    (None, None),
]


def test_lines(spark, gazetteer):
    table = spark.createDataFrame([(f"k{i}", line, "x") for i, (line, _) in enumerate(LINES)], "k string, city string, name string").repartition(3)
    got = {r.k: tuple(r)[1:] for r in peeled(table, "k", "city", gazetteer).collect()}
    assert got == {f"k{i}": want for i, (_, want) in enumerate(LINES) if want}
    assert peeled(table.limit(0), "k", "city", gazetteer).isEmpty()
    assert peeled(table, "k", "city", gazetteer.limit(0)).isEmpty()


def test_equal_lines_are_read_once(spark, gazetteer):
    rows = [(i, "Royal Hall, London" if i % 2 else "Stars - Toronto, ON May 5, 1990") for i in range(6)] + [(6, None), (7, "SBD"), (7, "SBD")]
    found = peeled(spark.createDataFrame(rows, "id long, line string").repartition(3), "id", "line", gazetteer)
    assert sorted((r.id, r.city, r.region, r.venue) for r in found.collect()) == [(i, "London", None, "Royal Hall") if i % 2 else (i, "Toronto", "Ontario", "Stars") for i in range(6)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # runs are made in one place of the plan, of distinct lines without their keys
    assert plan.count("posexplode(") == 1
    assert "id#" not in next(x for x in plan.splitlines() if "posexplode(" in x).split("[", 1)[1]
