import json
import math

import numpy as np
import pytest

from gyrolake.functions import kernels
from gyrolake.sources import measurements as m


def rotations_of(rows, joints):
    out = {}
    for r in rows:
        out.setdefault(r.seq, {})[r.t, r.joint] = np.array([r[f"r{k}"] for k in range(9)]).reshape(3, 3)
    return out


def test_encodings_agree(spark, tmp_path):
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.4, (7, 5, 3))
    r = kernels.exp(w)
    q = np.empty((7, 5, 4))
    for t in range(7):
        for j in range(5):
            angle = np.linalg.norm(w[t, j])
            q[t, j] = [*(w[t, j] / angle * math.sin(angle / 2)), math.cos(angle / 2)]
    root = rng.normal(0, 1, (7, 1, 3))
    files = {
        "flat": {"body_pose": w.reshape(7, 15).tolist()},
        "full": {"pose": np.concatenate([root, w], 1).reshape(7, 18).tolist()},
        "nested": {"poses": np.concatenate([root, w], 1).tolist(), "rotations": [[1, 2]]},
        "matrices": {"rotations": (r * 1.1).tolist()},
        "flat_matrices": {"pose_rotmat": r.reshape(7, 45).tolist()},
        "quaternions": {"quaternions": (-3 * q).tolist()},
        "frames": {"frames": [{"body_pose": x.reshape(15).tolist(), "score": 0.5, **({"mask": 1} if k else {})} for k, x in enumerate(w)]},
        "bad": {"pose": [[1, 2, 3]]},
    }
    for name, payload in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    (tmp_path / "broken.json").write_text("{")
    np.savez(tmp_path / "packed.npz", body_pose=w.reshape(7, 15), fps=20.0)
    how = m.Import(joints=5)
    parsed = m.parsed(spark, str(tmp_path), how)
    assert {r.seq: r.problem for r in parsed.filter("problem is not null").collect()} == {"bad": "no usable pose", "broken": "Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"}
    rows = m.measurements(m.usable(parsed), how).collect()
    got = rotations_of(rows, 5)
    assert set(got) == {*files, "packed"} - {"bad"}
    for name, poses in got.items():
        assert len(poses) == 35 and max(np.abs(poses[t, j] - r[t, j]).max() for t, j in poses) < 1e-9, name
    assert {x.confidence for x in rows if x.seq == "frames"} == {0.5} and all(x.mask for x in rows if x.seq == "frames")


def test_strides_values_and_noise(spark, tmp_path):
    t, j = 46, 3
    pose = np.full((t, 3 * j), 0.02)
    confidence = np.ones((t, j))
    confidence[6, 2], confidence[:, 1] = 0, 0.5
    mask = np.ones((t, j), bool)
    mask[6, 1] = False
    payload = {"body_pose": pose.tolist(), "confidence": confidence.tolist(), "mask": mask.tolist(), "mocap_framerate": 60, "joint_noise_sigma_deg": np.full((t, j), 6.0).tolist()}
    payload["body_pose"][9][0] = None
    (tmp_path / "a.json").write_text(json.dumps(payload))
    (tmp_path / "b.json").write_text(json.dumps({**payload, "sequence_name": "a", "mocap_framerate": 50, "confidence": 0.25}))
    (tmp_path / "c.json").write_text(json.dumps({**payload, "confidence": [0.1 * (k % 9) for k in range(46)], "mask": [1, 0, 1, 0], "noise_sigma_deg": 7}))
    (tmp_path / "d.json").write_text(json.dumps({**payload, "confidence": 2.0}))
    how = m.Import(joints=j)
    files = m.parsed(spark, str(tmp_path), how)
    assert {r.seq: r.problem for r in files.filter("problem is not null").collect()} == {"c": "mask fits neither frames nor joints", "d": "confidence outside 0 to 1"}
    (row,) = m.usable(files).collect()  # b has the name of a and comes later
    assert row.n == 23 and row.noise_sigma_rad == pytest.approx(math.radians(10))
    rows = {(r.t, r.joint): r for r in m.measurements(files.filter("path like '%/a.json'"), how).collect()}
    assert len(rows) == 16 * 3
    assert [k for k, r in rows.items() if not r.mask] == [(2, 1), (2, 2), (3, 0)] and rows[2, 1].confidence == 0 and rows[0, 1].confidence == 0.5
    assert rows[3, 0].r0 == 1 and rows[0, 0].sigma == pytest.approx(math.radians(6))


def test_motion_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "Sub").mkdir()
    for name, frames, extra in (("Sub/walk", 45, {"mocap_framerate": 60.0}), ("Sub/short", 2, {"fps": 60.0}), ("run", 9, {}), ("thin", 9, {})):
        poses = rng.normal(0, 0.1, (frames, 60 if name == "thin" else 156))
        np.savez(tmp_path / f"{name}.npz", poses=poses, **extra)
    files = m.motion_files(spark, str(tmp_path)).collect()
    assert {r.seq: (r.n, r.problem) for r in files} == {"walk": (15, None), "short": (1, None), "run": (3, None), "thin": (None, "too few numbers a frame")}
    assert {r.seq for r in m.motion_vectors(m.motion_files(spark, str(tmp_path))).select("seq").distinct().collect()} == {"walk", "run"}
    assert [r.seq for r in m.motion_files(spark, str(tmp_path), subset="sUB/W").collect()] == ["walk"]
    assert len(m.motion_files(spark, str(tmp_path), limit=2).collect()) == 2


def test_tracks(spark, tmp_path):
    from gyrolake.sources import tracks as k

    rng = np.random.default_rng(3)
    w, cam = rng.normal(0, 0.3, (7, 21, 3)), rng.normal(0, 0.3, (7, 21, 3))
    one = {"fps": 30, "confidence": np.full((7, 21), 0.7).tolist(), "smpl_params_global": {"global_orient": np.zeros((7, 3)).tolist(), "body_pose": w.reshape(7, 63).tolist()}, "smpl_params_incam": {"body_pose": cam.reshape(7, 63).tolist()}}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "map.json").write_text(json.dumps({"7": one, "note": "x", "9": {"poses": np.zeros((4, 72)).tolist(), "scores": np.zeros((4, 24, 3)).tolist()}}))
    (tmp_path / "list.json").write_text(json.dumps([{"no": 1}, one]))
    (tmp_path / "none.json").write_text(json.dumps({"a": 1}))
    np.savez(tmp_path / "mats.npz", pred_rotmat=kernels.exp(rng.normal(0, 0.3, (5, 24, 3))), frame_rate=20, scores=np.ones((5, 24)))
    how = m.Import(frame_rate=10)
    found = k.tracks(spark, str(tmp_path), how)
    assert {r.seq: (r.n, r.problem) for r in found.collect()} == {"one": (3, None), "map_7": (3, None), "map_9": (4, None), "list_001": (3, None), "none": (None, "no track of poses"), "mats": (3, None)}
    rows = m.measurements(m.usable(found), how).collect()
    poses = rotations_of(rows, 23)
    want = kernels.exp(w[::3])
    assert max(np.abs(poses["one"][t, j] - want[t, j]).max() for t in range(3) for j in range(21)) < 1e-9
    assert all(r.mask == (r.joint < 21) and r.confidence == (0.7 if r.mask else 0) for r in rows if r.seq == "one")
    assert not any(r.mask for r in rows if r.seq == "map_9") and len(poses["mats"]) == 69
    other = m.measurements(m.usable(k.tracks(spark, str(tmp_path), how, "incam")), how).filter("seq = 'one'").collect()
    assert np.abs(rotations_of(other, 23)["one"][1, 2] - kernels.exp(cam[3])[2]).max() < 1e-9
    assert k.tracks(spark, str(tmp_path), how, pad=False).filter("seq = 'one'").first().problem


def test_report_files(spark, tmp_path):
    from gyrolake.sources import reports as t

    assert t.read_csv(spark, str(tmp_path / "none"), ["a", "b"]).columns == ["a", "b"] and t.read_csv(spark, str(tmp_path / "none"), ["a"]).count() == 0
    df = spark.createDataFrame([(1.5, "x", None), (float("nan"), "y,z", 3), (float("inf"), "", 4)], "v double, s string, n int")
    t.write_csv(df, str(tmp_path / "csv"), ["s", "v", "more", "n"])
    got = t.read_csv(spark, str(tmp_path / "csv"))
    assert got.columns == ["s", "v", "more", "n"] and sorted(map(tuple, got.fillna("").collect())) == [("", "", "", "4"), ("x", "1.5", "", ""), ("y,z", "", "", "3")]
    t.write_json(df, str(tmp_path / "json"))
    assert t.read_json(spark, str(tmp_path / "json"), "v double, s string").filter("v is not null").count() == 1
    assert t.first_of(t.read_csv(spark, str(tmp_path / "none")), got).count() == 3
    assert t.tagged(df, s="tag", seed=3).select("s", "seed").distinct().count() == 3


def test_damaged_files_end_nothing(spark, tmp_path):
    from gyrolake.sources import tracks as k

    good = {"body_pose": np.zeros((4, 69)).tolist()}
    (tmp_path / "good.json").write_text(json.dumps(good))
    np.savez(tmp_path / "whole.npz", body_pose=np.zeros((4, 69)))
    (tmp_path / "cut.npz").write_bytes((tmp_path / "whole.npz").read_bytes()[:200])
    (tmp_path / "empty.npz").write_bytes(b"")
    (tmp_path / "deep.json").write_text("[" * 100_000 + "]" * 100_000)
    (tmp_path / "text.json").write_text('{"body_pose": "[[[[[')
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "brackets.json").write_text(json.dumps({**good, "note": "[" * 500}))
    np.savez(tmp_path / "objects.npz", body_pose=np.array([{"a": 1}], dtype=object))
    for rows in (m.parsed(spark, str(tmp_path)), k.tracks(spark, str(tmp_path))):
        told = {r.seq: r.problem for r in rows.select("seq", "problem").collect()}
        assert {s for s, p in told.items() if p is None} == {"good", "whole", "brackets"}
        assert told.keys() == {"good", "whole", "cut", "deep", "text", "bytes", "brackets", "objects"}  # Spark lists no empty files
        assert told["deep"] == "nested too deeply"
    assert m.motion_files(spark, str(tmp_path)).filter("problem is null").count() == 0


def test_values_of_tracks(spark, tmp_path):
    """Shapes of confidences, masks and poses, and what is taken where several would do."""
    from gyrolake.sources import tracks as k

    body = np.arange(2 * 4 * 3).reshape(2, 4, 3) / 100
    files = {
        "number": {"body_pose": body, "confidence": 0.5, "mask": [1, 0]},
        "frame": {"body_pose": body, "confidence": [0.25, 0.75]},
        "joint": {"body_pose": body.reshape(2, 12), "confidence": [9, 0.1, 0.2, 0.3, 0.4]},
        "root": {"poses": np.concatenate([np.full((2, 1, 3), 9.0), body], axis=1), "scores": [[[0, 0, 0.5]] * 5, [[0, 0, 1.0]] * 5]},
        "invalid": {"body_pose": body, "scores": 7, "a": {"confidence": [0.5, 0.25]}},
        "bad_first": {"a": {"body_pose": [1, 2]}, "x": {"pred_rotmat": np.tile(np.eye(3), (2, 4, 1, 1))}},
        "one_track": {"a": {"body_pose": [1, 2]}, "poses": body},
        "world": {"x": {"body_pose": body + 1}, "in_the_world": {"body_pose": body}},
        "few": {"body_pose": body[:, :2], "joint_noise_sigma_deg": [6.0], "fps": None, "source_fps": 40},
    }
    for name, f in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(f, default=lambda a: a.tolist()))
    how = m.Import(joints=4, frame_rate=20)
    found = {r.seq: r for r in k.tracks(spark, str(tmp_path), how).collect()}
    frames = lambda n: [(f.p, f.confidence, f.mask) for f in found[n].frames]
    flat = [x.ravel().tolist() for x in body]
    assert frames("number") == [(flat[0], [0.5] * 4, [1.0] * 4), (flat[1], [0.5] * 4, [0.0] * 4)]
    assert [c for _, c, _ in frames("frame")] == [[0.25] * 4, [0.75] * 4] and frames("joint")[1][1] == [0.1, 0.2, 0.3, 0.4]
    assert frames("root") == [(flat[0], [0.5] * 4, [1.0] * 4), (flat[1], [1.0] * 4, [1.0] * 4)] and found["root"].key == "poses"
    assert frames("invalid")[0][1] == [0.5] * 4 and found["bad_first_x"].width == 9 and "bad_first" not in found
    assert found["one_track"].problem == "no track of poses"  # it names poses itself, and the first of them has no shape of poses
    assert found["world_in_the_world"].n == 2 and found["world_x"].n == 2
    assert found["few"].n == 1 and frames("few")[0] == (flat[0][:6] + [0.0] * 6, [1.0, 1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0])
    assert found["few"].noise_sigma_rad == pytest.approx(math.radians(6)) and found["few"].fps == 40
