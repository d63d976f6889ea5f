import glob
import shutil

import numpy as np

from gyrolake.operators.particle_filter import Options, run_filter
from gyrolake.streaming.filters import event_counts, filtered_files, user_sessions
from tests.test_numeric import moving

SF = "/root/testdata/sf0.01"


def test_stream_equals_batch(spark, tmp_path):
    df = moving(spark, frames=6)
    for k, (a, b) in enumerate(((0, 2), (3, 3), (4, 5))):
        df.filter(f"t between {a} and {b}").coalesce(1).write.parquet(str(tmp_path / "part"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.move(glob.glob(str(tmp_path / "part" / "part-*"))[0], tmp_path / "in" / f"{k}.parquet")
        shutil.rmtree(tmp_path / "part")
    options = Options(particles=32)
    query = filtered_files(spark, str(tmp_path / "in"), options).writeStream.format("memory").queryName("est").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("est").toPandas().sort_values(["seq", "t", "joint"])
    want = run_filter(df, options).toPandas().sort_values(["seq", "t", "joint"])
    assert len(got) == len(want) == 36
    assert np.allclose(got[["e0", "e4", "ess"]], want[["e0", "e4", "ess"]])


def test_windows_and_sessions_as_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    for name, make in (("counts", event_counts), ("sessions", user_sessions)):
        query = make(source).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    batch = {(r.start, r.event_type): r.n for r in event_counts(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("counts").collect()} == batch
    done = {(r.user_id, r.start): r.n for r in spark.table("sessions").collect()}
    full = {(r.user_id, r.start): r.n for r in user_sessions(events).collect()}
    assert done.items() <= full.items()
