"""Snapshots of saved searches as keyed state: alerts come from what the state store holds, not from folders of earlier runs.

Time is cut into runs of equal length. An offer stream is first aggregated to each run's offers, which are complete when the watermark has
passed the run's end; then each search meets its own last run, which lives in the state store by group and by offer. Checkpoints
hold both, so that a stream that is stopped goes on where it was. What a search holds is its last run alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: run is the second (of Unix time) at which a run begins.
ALERT = "search_id string, run bigint, type string, groupKey string, url string, previousPrice double, currentPrice double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Urls of a group in one value of the state store, at most.
CHUNK = 4096


class _LastRun(StatefulProcessor):
    """One search: its groups of the last run, with their lowest prices, and their urls in chunks, since each access to the store is a call of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "key string", "minPrice double, chunks int")
        self.urls = handle.getMapState("urls", "key string, chunk int", "urls array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # Rows of the runs that this micro-batch completes, usually one. What lies between two of them needn't be stored.
        last = {k[0]: (v[0], v[1]) for k, v in self.groups.iterator()}
        known = {group: price for group, (price, _) in last.items()}
        seen = {group: pd.Index([u for i in range(n) for u in self.urls.getValue((group, i))[0]]) for group, (_, n) in last.items()}
        for run, offers in pd.concat(rows).groupby("run", sort=True):
            now = dict(iter(offers.sort_values(["key", "url"]).groupby("key", sort=True)))
            yield self._alerts(key[0], run, now, known, seen)
            known, seen = {group: o["price"].min() for group, o in now.items()}, {group: pd.Index(o["url"]) for group, o in now.items()}
        for group in set(last) - set(known):
            self.groups.removeKey((group,))
        for group, price in known.items():
            urls = seen[group].tolist()
            chunks = [urls[i : i + CHUNK] for i in range(0, len(urls), CHUNK)]
            for i, chunk in enumerate(chunks):
                self.urls.updateValue((group, i), (chunk,))
            self.groups.updateValue((group,), (float(price), len(chunks)))
        for group, (_, n) in last.items():
            for i in range(-(-len(seen.get(group, ())) // CHUNK), n):
                self.urls.removeKey((group, i))

    def _alerts(self, search_id: str, run: int, now: dict[str, pd.DataFrame], known: dict[str, float], seen: dict[str, pd.Index]) -> pd.DataFrame:
        of_groups, of_offers = [], []
        for group, offers in now.items():
            price = offers["price"].min()
            if group not in known:
                of_groups.append(("new_group", group, None, None, price))
            else:
                if price < known[group]:
                    of_groups.append(("price_drop", group, None, known[group], price))
                new = offers[~offers["url"].isin(seen[group])]
                of_offers.append(pd.DataFrame({"type": "new_offer", "groupKey": group, "url": new["url"], "previousPrice": None, "currentPrice": new["price"]}))
        columns = ["type", "groupKey", "url", "previousPrice", "currentPrice"]
        made = pd.concat([pd.DataFrame(of_groups, columns=columns).astype(object), *[o.astype(object) for o in of_offers]], ignore_index=True)
        made.insert(0, "run", run)
        made.insert(0, "search_id", search_id)
        return made

    def close(self) -> None:
        pass


def snapshot_stream(offers: DataFrame, every: str, late: str = "0 seconds") -> DataFrame:
    """Alerts of a stream of offers (ts, search_id, key, url, price), a run for each `every` of event time.

    A url that is seen several times in a run counts with its lowest price. Rows without a search, group, url or price are no offers. Rows that are
    later than `late` behind are dropped. new_group, price_drop and new_offer are against the search's last run that had offers.
    """
    spark = offers.sparkSession
    use_state_store(spark)
    whole = offers.where("search_id is not null and key is not null and url is not null and price is not null").withWatermark("ts", late)
    runs = whole.groupBy(F.window("ts", every), "search_id", "key", "url").agg(F.min("price").alias("price"))
    rows = runs.select("search_id", F.unix_seconds("window.start").alias("run"), "key", "url", "price")
    return rows.groupBy("search_id").transformWithStateInPandas(statefulProcessor=_LastRun(), outputStructType=ALERT, outputMode="Append", timeMode="None")


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed state needs, for streams that this session starts from now on."""
    spark.conf.set(_PROVIDER, _ROCKS)


def watch_state(offers: DataFrame, every: str, alerts_path: str, checkpoint: str, late: str = "0 seconds"):
    """Start a query that appends alerts to a Parquet folder, what is there now, then stops; called again it goes on."""
    return snapshot_stream(offers, every, late).writeStream.format("parquet").option("path", alerts_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
