"""Keyed stream state: the same rows in any batches, silences, returns, failures, forgetting."""

import datetime as dt
import random

import pytest

from pricewatch_spark.streaming import changes as stream

SCHEMA = "source_id string, source_external_id string, scraped_at timestamp, pos long, hash string, price string, availability string, raw_title string, observed_stock int"
START = dt.datetime(2026, 1, 1)


def hour(x):
    return START + dt.timedelta(hours=x)


def row(key, at, pos, state, title="t", stock=1):
    return ("a", key, hour(at) if at is not None else None, pos, state, "1.50" if state == "h1" else None, "IN", title, stock)


def played(spark, rows, batches, folder, of):
    """What of(stream) has written when rows have come in so many batches, in order."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:04d}")
        files = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        of(files).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out").awaitTermination(120)
    return spark.read.parquet(f"{folder}/out")


def model(rows, silent, delay=1, forget=None, revive=True):
    """One row after the other, up to an hour before the last."""
    end = max(r[2] for r in rows if r[2]) - dt.timedelta(hours=delay)
    gap, out, known = dt.timedelta(hours=silent), [], {}

    def silence(key, at):
        if key in known and known[key][1] != "DELISTED" and at > known[key][2] + gap:
            out.append((key, known[key][2] + gap, "delisted"))
            known[key] = (known[key][0], "DELISTED", known[key][2])
        if forget is not None and key in known and at > known[key][2] + gap + dt.timedelta(hours=forget):
            del known[key]

    for r in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[3])):
        if r[7].strip() == "" or r[8] < 0:
            out.append((r[1], r[2], "failed"))
        elif r[2] <= end:
            silence(r[1], r[2])
            before = known.get(r[1])
            state = r[6]
            if before is None:
                out.append((r[1], r[2], "created"))
            elif before[0] != r[4] or (before[1] == "DELISTED" and revive):
                out.append((r[1], r[2], "changed"))
            elif before[1] == "DELISTED":
                state = "DELISTED"
            known[r[1]] = (r[4], state, r[2])
    for key in list(known):
        silence(key, end)
    return sorted(out)


def changes_of(df):
    return sorted((r.source_external_id, r.scraped_at, r.change) for r in df.collect())


def long_rows():
    r = random.Random(6)
    times = sorted(r.uniform(0, 400) for _ in range(90))
    rows = [row(f"k{r.randrange(9)}", round(t, 2), k, r.choice(["h1", "h2"]), " " if k % 17 == 0 else "t", -1 if k % 19 == 0 else 1) for k, t in enumerate(times)]
    return [*rows, row("last", 500, 90, "h1")]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_states_do_not_depend_on_batches(spark, tmp_path, batches):
    rows = long_rows()
    expected = model(rows, 48)
    assert {"created", "changed", "delisted", "failed"} == {x[2] for x in expected} and len(expected) > 60
    assert changes_of(played(spark, rows, batches, tmp_path, lambda s: stream.change_stream(s, silent_minutes=48 * 60))) == expected


def test_returns_without_revival_and_forgotten_listings(spark, tmp_path):
    rows = long_rows()
    kept = played(spark, rows, 2, tmp_path / "kept", lambda s: stream.change_stream(s, silent_minutes=24 * 60, revive=False))
    assert changes_of(kept) == model(rows, 24, revive=False)
    gone = played(spark, rows, 2, tmp_path / "gone", lambda s: stream.change_stream(s, silent_minutes=24 * 60, forget_minutes=12 * 60))
    assert changes_of(gone) == model(rows, 24, forget=12)
    assert sum(x[2] == "created" for x in changes_of(gone)) > sum(x[2] == "created" for x in changes_of(kept))


def test_a_silence_inside_one_batch_and_rows_without_time(spark, tmp_path):
    rows = [row("k", 0, 0, "h1"), row("o", 60, 1, "h1"), row("k", 61, 2, "h2"), row("k", None, 3, "h2"), row("z", 62, 4, "h1"), row("z", 70, 5, "h1")]
    found = played(spark, rows, 1, tmp_path, stream.change_stream)
    assert [x[2] for x in changes_of(found.where("source_external_id = 'k' and change <> 'failed'"))] == ["created", "delisted", "changed"]


@pytest.mark.parametrize("batches", [1, 4])
def test_repeats_within_the_delay_go(spark, tmp_path, batches):
    rows = [row("k", t, k, "h1") for k, t in enumerate([0, 0, 0.5, 1.2, 10, 10.9, 12.1])] + [row("o", 13, 9, "h1")]
    kept = played(spark, rows, batches, tmp_path, lambda s: stream.dedup_stream(s, ["source_external_id"], delay="1 hour"))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted((r.scraped_at - START).total_seconds() / 3600 for r in kept.where("source_external_id = 'k'").collect()) == [0, 10, 12.1]
