"""Small random histories and a shorthand for building frames from them."""

import random
from datetime import datetime, timedelta, timezone

START = datetime(2024, 3, 1, 12, 0, tzinfo=timezone.utc)
SCHEMA = "station_id long, ts timestamp, temp double, humidity double, pressure double, rain_flag double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def us(ts):
    return int(ts.replace(tzinfo=ts.tzinfo or timezone.utc).timestamp() * 1e6 + 0.5)


def series(seed, rows, steps=(60, 60, 60, 60, 58, 63, 3, 130, 300, 700, 4000), wet=0.1, station=0):
    """Irregular readings that cross several days, with runs of rain."""
    rng, t, out, raining = random.Random(seed), 0, [], False
    for _ in range(rows):
        t += rng.choice(steps)
        if rng.random() < 0.08:
            raining = rng.random() < wet * 4
        out.append((station, at(t), rng.randrange(200) / 10, rng.randrange(100) / 1.0, 1000 + rng.randrange(40) / 4, 1.0 if raining else 0.0))
    return out


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
