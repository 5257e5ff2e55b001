"""Queries run over whole tables, not over the first keys."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import hashing
from tallyforge.plans import games, logs


def test_context_history_covers_every_user(spark, tmp_path):
    rows = [(i, i * 7 % 130 + (i % 3) * 1_000_000) for i in range(2_000)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    cards, want = defaultdict(list), []
    for event, user in rows:
        cards[user].append((event, min(event % 13 + 1, 10)))
    for user, held in cards.items():
        hand = Counter((10, 5))
        for event, card in held:
            if hand[card]:
                hand[card] -= 1
            else:
                want.append((user, event, card))
    got = [tuple(r) for r in games.context_history(spark, f"file://{tmp_path}").select("user_id", "event_id", "card").collect()]
    assert sorted(got) == sorted(want) and len(cards) > 60 and max(u for u, _, _ in got) > 1_000_000


def test_sampling_error_covers_every_part(spark, tmp_path):
    parts = [(k, k % 50 + 1) for k in range(1, 101)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"file://{tmp_path}/part.parquet")
    got = {r["budget"]: r for r in games.sampling_error(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {100, 1_000, 10_000}
    for budget, r in got.items():
        same = 0
        for key, size in parts:
            win = 0.45 + size / 500
            for rep in range(20):
                lost, won = np.random.default_rng([7, key, budget, rep]).multinomial(budget, [1 - win, win])
                best = max((2 * win - 1, "stand"), (0.0, "surrender"))[1]
                same += best == ("stand" if won - lost >= 0 else "surrender")
        assert r["comparisons"] == 100 * 20 and abs(r["agreement"] - same / 2_000) < 1e-3


def test_splitmix_takes_ids_of_any_size(spark, tmp_path):
    ids = [0, 1, 99_999, 100_000, 100_001, 199_999, 200_001, 5_999_999, 2**32, 2**47 + 1, 2**63 - 1, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    m, want = (1 << 64) - 1, {None: None}
    for i in ids[:-1]:
        v = (i * 92233720368547 + hashing.GAMMA) & m
        v = ((v ^ (v >> 30)) * hashing.MIX_1) & m
        v = ((v ^ (v >> 27)) * hashing.MIX_2) & m
        want[i] = f"{v ^ (v >> 31):X}"
    got = [tuple(r) for r in logs.splitmix64(spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(ids) and dict(got) == want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
        assert dict(db.sql(logs.SPLITMIX64).fetchall()) == want


def test_product_wraps(spark):
    xs = (0, 1, -1, 2**31, 2**32 + 1, 2**63 - 1, -(2**63), -12_345_678_901)
    rows = spark.createDataFrame([(x,) for x in xs], "x long")
    for by in (0, 1, 92233720368547, hashing.MIX_1, (1 << 64) - 1):
        got = {r["x"]: r["y"] for r in rows.select("x", hashing.product(F.col("x"), by).alias("y")).collect()}
        assert {x: y % (1 << 64) for x, y in got.items()} == {x: x * by % (1 << 64) for x in xs}
