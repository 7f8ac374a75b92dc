"""What keeps queries fast on large tables, and that it changes no row."""

import random
from collections import Counter

import pandas as pd
import pytest

from pyspark.sql import functions as F

from offerlake import queries
from offerlake.operators import grouping, match, ranking
from offerlake.plans import query_plan
from offerlake.streaming import state

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_read_a_query_once(spark):
    """each pattern was tried again for every variant, and for every pair of variants."""
    plan = plan_of(spark.createDataFrame([("x",)], "query string").select(query_plan.query_variants(F.col("query")).alias("v")))
    assert plan.count("megabass|evergreen") == 1


def test_variants_run_on_all_cores(spark):
    """a small file of parts was one task."""
    assert queries.query_variants(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_searches_of_one_text_score_an_offer_once(spark, monkeypatch):
    """F1: 40 searches times 600 offers of one title were scored, though each takes the best three."""
    scored = []
    monkeypatch.setattr(match, "score_offers", lambda df, asked: scored.append(df) or ranking.score_offers(df, asked))
    none = F.array().cast("array<string>")
    offers = spark.range(600).select(
        F.col("id").alias("seq"), F.lit("Tict Ice Cube IC-69P").alias("title"), F.concat(F.lit("https://x/"), "id").alias("url"), F.when(F.col("id") % 3 > 0, F.col("id") % 7 * 10.0).alias("price"), F.when(F.col("id") % 2 == 0, "used").alias("condition"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit("2.1m"))).when(F.col("id") % 5 == 1, none).alias("evidence"), (F.col("id") * 37 % 11 / 10.0).alias("confidence"), F.lit("s").alias("sourceSite"), F.lit("s").alias("seller"), none.alias("warnings"),
    )
    searches = spark.range(40).select(F.col("id").alias("search_id"), F.when(F.col("id") < 39, "tict ic-69p").otherwise("tict ice cube ic-69p 2.1m").alias("query"))
    for wanted in (ranking.OfferFilter(limit=3), ranking.OfferFilter(min_price=20, condition="used", limit=3)):
        got = match.match_searches(searches, offers, wanted).orderBy("search_id", "place").collect()
        assert scored.pop().count() <= 2 * 3 * 12
        for i in range(40):
            single = ranking.rank_offers(offers, "tict ic-69p" if i < 39 else "tict ice cube ic-69p 2.1m", wanted).collect() if i in (0, 39) else single
            assert [(r["seq"], r["relevanceScore"]) for r in got if r["search_id"] == i] == [(r["seq"], r["relevanceScore"]) for r in single]


def test_offers_are_read_once_for_families(spark):
    """all line items were read again, for titles that the catalogue lacks."""
    assert plan_of(queries.group_offers_summary(spark, SF)).count("Relation [l_orderkey") == 1


def test_families_list_values_in_order(spark):
    """each offer gave a row for each value of its family, its whole self in each."""
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    rows = [(i, "t", f"https://x/{r.randrange(60)}", pick(None, 5.0, 7.0, float("nan")), pick(None, "", "UAH", "USD", "JPY"), pick("s1", "s2", "", None), pick("www.a", "b", "c", None), r.random() // 0.25 / 4, pick(0.5, 0.6), r.choice([("x-1", "1"), ("2", "x-1"), (), None])) for i in range(300)]
    o = spark.createDataFrame(rows, "seq long, title string, url string, price double, currency string, seller string, sourceSite string, relevanceScore double, confidence double, codes array<string>")
    o = o.withColumn("specs", F.lit(None).cast("string")).withColumn("normalized", F.struct(F.lit("shimano").alias("brand"), F.col("codes").alias("modelCodes"), F.lit("fam").alias("family"))).drop("codes")
    got = grouping.group_offers(o).collect()
    assert plan_of(grouping.group_offers(o)).count("inline(array(struct(whole") == 1
    nan = lambda x: (1, 0.0) if x != x else (0, x)
    place = lambda x: (-x[7], nan(9007199254740991.0 if x[3] is None else x[3]), -x[8], x[0])
    best = {}
    for x in sorted(rows, key=place):
        best.setdefault(x[2], x)
    once = sorted(best.values(), key=place)
    source = lambda x: x[6] and x[6].removeprefix("www.")
    listed = lambda values: list(dict.fromkeys(v for v in values if v is not None))
    money = [x[4] for x in once if x[4]]
    times = Counter(money)
    (g,) = got
    assert g["offerCount"] == len(once) and g["bestUrl"] == once[0][2]
    assert g["sources"] == listed(source(x) for x in once)
    assert g["sellers"] == listed(x[5] or source(x) for x in once)
    assert g["modelCodes"] == listed(c for x in once for c in x[9] or ())
    assert g["currency"] == min(times, key=lambda c: (-times[c], money.index(c)))


def test_identities_of_other_models_are_left_out_early(spark):
    """every offer's whole row was shuffled, of which 249 in 250 are of another model."""
    titles = ["Tict IC-61E rod", "Tict IC-69P rod", "Tict rod", "Shimano IC-61E", None]
    none = F.array().cast("array<string>")
    title = F.element_at(F.array(*[F.lit(t) for t in titles]), (F.xxhash64("id") % 5 + 5).cast("int") % 5 + 1)
    offers = spark.range(400).select(
        F.col("id").alias("seq"), title.alias("title"), F.concat(F.lit("https://x/"), F.col("id") % 150).alias("url"), F.lit(5.0).alias("price"), F.lit(None).cast("string").alias("condition"), none.alias("evidence"),
        (F.col("id") * 37 % 11 / 10.0).alias("confidence"), F.lit("s").alias("sourceSite"), F.lit("s").alias("seller"), none.alias("warnings"),
    )
    # The catalogue lacks a title.
    features = ranking.title_features(offers.where("title <> 'Shimano IC-61E'"))
    without = ranking.other_models(features, "tict ic-61e")
    assert [r["title"] for r in without.collect()] == ["Tict IC-69P rod"]
    whole, short = ranking.dedupe_offers(offers), ranking.dedupe_offers(offers, without)
    assert short.count() < whole.count()
    rank = lambda o: [tuple(map(str, r)) for r in ranking.rank_offers(o, "tict ic-61e", ranking.OfferFilter(), features).collect()]
    assert rank(short) == rank(whole) != []


class Store:
    """A map of the state store that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, name, *_):
        self.__dict__[name] = store = Store()
        return store

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def keys(self):
        return iter(list(self.held))


@pytest.mark.parametrize("chunk", [3, 4096])
def test_last_run_in_few_calls(monkeypatch, chunk):
    """the store was called for each offer of each run."""
    monkeypatch.setattr(state, "CHUNK", chunk, raising=False)
    handle, r, last = Store(), random.Random(3), {}
    search = state._LastRun()
    search.init(handle)
    for batch in range(8):
        runs = {2 * batch + i: {(f"g{r.randrange(4)}", f"u{r.randrange(40)}"): float(r.randrange(9)) for _ in range(r.choice((3, 60)))} for i in range(r.randint(1, 2))}
        want = []
        for run, now in runs.items():
            least = lambda offers: {g: min(p for (h, _), p in offers.items() if h == g) for g, _ in offers}
            was, known = last, least(last)
            for g, p in least(now).items():
                if g not in known or p < known[g]:
                    want.append((run, "price_drop" if g in known else "new_group", g, None, known.get(g), p))
            want += [(run, "new_offer", g, u, None, p) for (g, u), p in now.items() if g in known and (g, u) not in was]
            last = now
        rows = pd.DataFrame([(run, g, u, p) for run, now in runs.items() for (g, u), p in now.items()], columns=["run", "key", "url", "price"])
        before = sum(handle.__dict__[n].calls for n in ("groups", "urls") if n in handle.__dict__)
        made = pd.concat(search.handleInputRows(("s",), iter([rows.iloc[::2], rows.iloc[1::2]]), None))
        got = [tuple(None if x != x else x for x in row) for row in made.drop(columns="search_id").itertuples(index=False)]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {k[0] for k in handle.groups.held} == {g for g, _ in last}
        assert sorted((k[0], u) for k, v in handle.urls.held.items() for u in v[0]) == sorted(last)
        if chunk > 1000:
            assert handle.groups.calls + handle.urls.calls - before <= 5 * 4
