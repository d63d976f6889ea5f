"""Pose measurements and motion sequences from array files, as rows (seq, t, joint).

A task turns a file into one row with a list of frames; from there all is done on
columns: names, duplicates, lengths, joints, rotations, masks. Files that cannot be used
are rows with the reason, and stop nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import kernels
from gyrolake.functions import rotations as R
from gyrolake.sources.files import arrays_of, list_files, with_content

# The keys under which tools of this kind store their arrays, in order of preference.
MATRIX_KEYS = ("rotations", "body_rotations", "body_pose_rotmat", "pose_rotmat", "pose_rotmats", "pred_rotmat", "pred_rotmats", "full_pose_rotmat")
AXIS_ANGLE_KEYS = ("poses", "body_pose", "smpl_body_pose", "pred_body_pose", "pose_body", "pose", "full_pose", "axis_angle", "axis_angles")
QUATERNION_KEYS = ("quaternions", "body_quaternions", "body_quat", "pose_quat", "pose_quaternions", "pred_quat", "pred_quaternions")
CONFIDENCE_KEYS = ("confidence", "confidences", "joint_confidence", "joint_confidences", "body_pose_confidence", "scores", "score", "joint_scores", "keypoint_scores")
MASK_KEYS = ("mask", "masks", "visible", "visibility", "valid", "valid_mask")
SIGMA_RAD_KEYS = ("joint_noise_sigma_rad", "measurement_noise_sigma_rad", "joint_sigma_rad", "sigma_rad")
SIGMA_DEG_KEYS = ("joint_noise_sigma_deg", "measurement_noise_sigma_deg", "joint_sigma_deg", "sigma_deg")
FPS_KEYS = ("mocap_framerate", "mocap_frame_rate", "fps", "frame_rate", "source_fps")
NOISE_RAD_KEYS, NOISE_DEG_KEYS = ("noise_sigma_rad", "measurement_noise_sigma_rad"), ("noise_sigma_deg", "measurement_noise_sigma_deg")
SUFFIXES = (".npz", ".json")
FRAME = pa.struct([("p", pa.list_(pa.float64())), ("confidence", pa.list_(pa.float64())), ("mask", pa.list_(pa.float64())), ("sigma", pa.list_(pa.float64()))])
MEASURED = pa.schema([("path", pa.string()), ("seq", pa.string()), ("fps", pa.float64()), ("key", pa.string()), ("width", pa.int32()), ("noise_sigma_rad", pa.float64()), ("frames", pa.list_(FRAME)), ("n", pa.int32()), ("problem", pa.string())])
MEASURED_SQL = "path string, seq string, fps double, key string, width int, noise_sigma_rad double, frames array<struct<p: array<double>, confidence: array<double>, mask: array<double>, sigma: array<double>>>, n int, problem string"


@dataclass(frozen=True)
class Import:
    """How files are read: rate and joints wanted, the noise assumed, keys that override the usual ones."""

    frame_rate: int | None = 20
    joints: int = 23
    noise_deg: float = 10.0
    pose_key: str | None = None
    mask_key: str | None = None
    confidence_key: str | None = None
    sigma_key: str | None = None
    confidence_scale: float = 1.0
    quaternion_order: str = "xyzw"
    min_frames: int = 1


def chosen(held: dict, keys: tuple[str, ...], own: str | None = None) -> str | None:
    """The first key that is there; ``own`` must be."""
    if own and own not in held:
        raise ValueError(f"no key {own}")
    return own or next((k for k in keys if k in held), None)


def first_number(held: dict, keys: tuple[str, ...], valid: Callable[[float], bool] = lambda x: True) -> float | None:
    numbers = (float(held[k].ravel()[0]) for k in keys if isinstance(held.get(k), np.ndarray) and held[k].size)
    return next((x for x in numbers if valid(x)), None)


def stride_of(fps: float | None, frame_rate: int | None) -> int:
    """Source frames for each frame, half to even, at least 1; 1 where a rate is unknown."""
    return max(1, round(fps / frame_rate)) if fps and frame_rate else 1


def skipped(key: str, there: int, wanted: int) -> int:
    """The joints before the first wanted one: of more than are wanted the root, unless the key's joints are the body's alone."""
    if there < wanted:
        raise ValueError(f"{key} has {there} joints of {wanted}")
    return 0 if there == wanted or ("body" in key.lower() and "full" not in key.lower()) else 1


def pose_blocks(held: dict, how: Import) -> tuple[str, np.ndarray]:
    """(key, frames x joints x width) of the first key with a usable table; width is 9, 3 or 4."""
    for key in [how.pose_key] if how.pose_key else [*MATRIX_KEYS, *AXIS_ANGLE_KEYS, *QUATERNION_KEYS]:
        a = held.get(key)
        if not isinstance(a, np.ndarray) or not a.ndim:
            continue
        name = key.lower()
        if key in MATRIX_KEYS or a.shape[-2:] == (3, 3) or name.endswith("rotmat"):
            width = 9
            a = a.reshape(*a.shape[:-2], 9) if a.shape[-2:] == (3, 3) else a
            a = a[None] if a.ndim == 2 and a.shape[-1] == 9 and held[key].ndim == 3 else a
        else:
            width = 4 if key in QUATERNION_KEYS or "quat" in name or (a.ndim > 1 and a.shape[-1] == 4) else 3
            a = a[None] if a.ndim == 1 and width == 3 else a
        if a.ndim == 2:  # flat frames; numbers beyond whole joints are not joints
            joints = a.shape[1] // width
            if width != 3 and a.shape[1] % width:
                continue
            a = a[:, : joints * width].reshape(len(a), joints, width)
        if a.ndim == 3 and a.shape[2] == width and a.shape[1] >= how.joints:
            first = skipped(key, a.shape[1], how.joints)
            return key, a[:, first : first + how.joints]
    raise ValueError("no usable pose")


def spread(held: dict, key: str, frames: int, joints: int, stride: int) -> np.ndarray:
    """A key's values for each frame and joint: one number, one a frame, one a joint, or a table, with or without more joints."""
    a = held[key]
    if not isinstance(a, np.ndarray):
        raise ValueError(f"{key} holds no numbers")
    if a.ndim == 0:
        return np.full((frames, joints), float(a))
    a = a[::stride]
    if a.ndim == 3 and a.shape[2] == 1:
        a = a[:, :, 0]
    if a.shape == (frames,):
        return np.repeat(a[:, None], joints, axis=1)
    if a.shape == (joints,):
        return np.repeat(a[None], frames, axis=0)
    if a.ndim == 2 and len(a) == frames and a.shape[1] >= joints:
        first = skipped(key, a.shape[1], joints)
        return a[:, first : first + joints]
    raise ValueError(f"{key} fits neither frames nor joints")


def measured(path: str, content: bytes, how: Import) -> dict:
    """One file's row of MEASURED."""
    held = arrays_of(path, content)
    fps = first_number(held, FPS_KEYS, lambda x: np.isfinite(x) and x > 0)
    stride = stride_of(fps, how.frame_rate)
    key, blocks = pose_blocks(held, how)
    blocks = blocks[::stride]
    n, joints, width = blocks.shape
    if not n:
        raise ValueError("no frames")
    if width == 9:
        even = np.isfinite(blocks).all(axis=2)
        blocks = blocks.copy()
        blocks[even] = kernels.project(blocks[even].reshape(-1, 3, 3)).reshape(-1, 9)
    values = {"confidence": None, "mask": None, "sigma": None}
    if k := chosen(held, CONFIDENCE_KEYS, how.confidence_key):
        c = spread(held, k, n, joints, stride) / how.confidence_scale
        values["confidence"] = np.where(np.isfinite(c), c, 0.0)
        if ((values["confidence"] < 0) | (values["confidence"] > 1)).any():
            raise ValueError("confidence outside 0 to 1")
    if k := chosen(held, MASK_KEYS, how.mask_key):
        values["mask"] = (spread(held, k, n, joints, stride) != 0).astype(float)
    if k := chosen(held, (*SIGMA_RAD_KEYS, *SIGMA_DEG_KEYS), how.sigma_key):
        s = spread(held, k, n, joints, stride)
        values["sigma"] = np.radians(s) if k.endswith("_deg") else s
        if not (np.isfinite(values["sigma"]) & (values["sigma"] > 0)).all():
            raise ValueError("noise not above zero")
    rad, deg = first_number(held, NOISE_RAD_KEYS), first_number(held, NOISE_DEG_KEYS)
    noise = rad if rad is not None else np.radians(how.noise_deg if deg is None else deg)
    if not (np.isfinite(noise) and noise > 0):
        raise ValueError("noise not above zero")
    frames = [{"p": blocks[t].ravel(), **{c: None if x is None else x[t] for c, x in values.items()}} for t in range(n)]
    return {"fps": fps, "key": key, "width": width, "noise_sigma_rad": float(noise), "frames": frames, "n": n, "seq": held.get("sequence_name") if isinstance(held.get("sequence_name"), str) else None}


def name_of(path: str) -> str:
    """A file's name without its last suffix; of a part file in a folder ``column=value``, the value."""
    folder, _, name = path.rpartition("/")
    if name.startswith("part-") and "=" in folder.rsplit("/", 1)[-1]:
        return folder.rsplit("=", 1)[-1]
    return name.rsplit(".", 1)[0]


def _rows_of(read: Callable[[str, bytes], dict | list[dict]], schema: pa.Schema):
    """The rows that ``read`` gives for each file, or one with its problem, whatever is wrong with the file; only a lack of memory ends the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    row = read(path, content.as_py())
                except MemoryError:
                    raise
                except Exception as why:  # noqa: BLE001  damaged archives raise errors of many kinds
                    row = {"problem": str(why)[:200] or type(why).__name__}
                for r in row if isinstance(row, list) else [row]:
                    yield pa.RecordBatch.from_pylist([{"path": path, **r, "seq": r.get("seq") or name_of(path)}], schema)

    return rows


def parsed(spark: SparkSession, root: str, how: Import | None = None, subset: str = "", limit: int | None = None) -> DataFrame:
    """One row a file: path, seq, fps, key, width, noise_sigma_rad, frames, n, problem (null if usable)."""
    how = how or Import()
    files = with_content(spark, list_files(spark, root, SUFFIXES, subset, limit=limit), root)
    return files.mapInArrow(_rows_of(lambda path, content: measured(path, content, how), MEASURED), MEASURED_SQL)


def usable(files: DataFrame, min_frames: int = 1) -> DataFrame:
    """The usable files of enough frames; of those of one name, the last by path."""
    last = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("path")))
    return files.filter(F.col("problem").isNull() & (F.col("n") >= min_frames)).withColumn("nth", last).filter("nth = 1").drop("nth")


def _rotations(rows: DataFrame, order: str) -> DataFrame:
    """Adds r0..r8 and finite to rows with width and p (a joint's numbers): non-finite ones stand still."""
    p = lambda k: F.get("p", k)
    quaternion = R.canonical([p(k) for k in ((1, 2, 3, 0) if order == "wxyz" else (0, 1, 2, 3))])
    rows = rows.withColumns(dict(zip(("__x", "__y", "__z", "__q0", "__q1", "__q2", "__q3"), (p(0), p(1), p(2), *quaternion), strict=True)))
    rows = R.with_exp(rows, ["__x", "__y", "__z"], "__e")
    turned = R.from_quaternion([F.col(f"__q{k}") for k in range(4)])
    picked = [F.when(F.col("width") == 3, F.col(f"__e{k}")).when(F.col("width") == 9, p(k)).otherwise(turned[k]) for k in range(9)]
    rows = rows.withColumns(dict(zip(R.names("__r"), picked, strict=True)))
    rows = rows.withColumn("finite", F.forall(F.array(*R.cols("__r")), lambda x: R.finite(x).isNotNull()))
    unit = [1.0 if k % 4 == 0 else 0.0 for k in range(9)]
    rows = rows.withColumns({f"r{k}": F.when(F.col("finite"), F.col(f"__r{k}")).otherwise(F.lit(unit[k])) for k in range(9)})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def measurements(files: DataFrame, how: Import | None = None) -> DataFrame:
    """(seq, t, joint, r0..r8, mask, confidence, sigma) of usable files; sigma is null where only the sequence's noise is known.

    A joint is seen if its rotation is finite, no mask hides it and its confidence is above zero; others have confidence 0.
    """
    how = how or Import()
    frames = files.select("seq", "width", F.posexplode("frames").alias("t", "f")).select("seq", "width", "t", "f.*")
    joint = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(how.joints - 1))).alias("joint"))
    numbers = F.slice("p", F.col("joint") * F.col("width") + 1, F.col("width"))
    rows = joint.select("seq", "t", "joint", "width", numbers.alias("p"), *[F.get(c, F.col("joint")).alias(c) for c in ("confidence", "mask", "sigma")])
    confidence = F.coalesce("confidence", F.lit(1.0))
    seen = F.col("finite") & F.coalesce(F.col("mask") != 0, F.lit(True)) & (confidence > 0)
    return _rotations(rows, how.quaternion_order).select("seq", "t", "joint", *R.names("r"), seen.alias("mask"), F.when(seen, confidence).otherwise(F.lit(0.0)).alias("confidence"), "sigma")


def load_measurements(spark: SparkSession, root: str, how: Import | None = None, subset: str = "") -> DataFrame:
    how = how or Import()
    return measurements(usable(parsed(spark, root, how, subset), how.min_frames), how)


MOTION = pa.schema([("path", pa.string()), ("seq", pa.string()), ("fps", pa.float64()), ("frames", pa.list_(pa.list_(pa.float64()))), ("n", pa.int32()), ("source_frames", pa.int32()), ("numbers", pa.int32()), ("problem", pa.string())])
MOTION_SQL = "path string, seq string, fps double, frames array<array<double>>, n int, source_frames int, numbers int, problem string"


def motion_files(spark: SparkSession, root: str, frame_rate: int = 20, joints: int = 23, subset: str = "", limit: int | None = None) -> DataFrame:
    """One row a motion file: path, seq, fps, frames (strided), n, source_frames, numbers, problem. A rate not given is 60.

    A ``limit`` cuts the list of files before unusable and short ones are left out.
    """

    def read(path: str, content: bytes) -> dict:
        held = arrays_of(path, content)
        poses = held.get("poses")
        if not isinstance(poses, np.ndarray) or poses.ndim != 2:
            raise ValueError("no table of poses")
        fps = first_number(held, FPS_KEYS[:3])
        fps = 60.0 if fps is None else fps
        row = {"seq": held.get("sequence_name") if isinstance(held.get("sequence_name"), str) else None, "fps": fps, "source_frames": len(poses), "numbers": poses.shape[1]}
        if poses.shape[1] < 3 + 3 * joints:
            return {**row, "problem": "too few numbers a frame"}
        frames = poses[:: stride_of(fps, frame_rate), : 3 + 3 * joints]
        return {**row, "frames": list(frames), "n": len(frames)}

    files = with_content(spark, list_files(spark, root, SUFFIXES, subset, limit=limit), root)
    return files.mapInArrow(_rows_of(read, MOTION), MOTION_SQL)


def is_motion(min_frames: int = 2, min_numbers: int = 72) -> Column:
    """Whether a motion file holds a table of poses of enough frames and numbers."""
    return F.coalesce((F.col("source_frames") >= min_frames) & (F.col("numbers") >= min_numbers), F.lit(False))


def motion_vectors(files: DataFrame, joints: int = 23, min_frames: int = 2) -> DataFrame:
    """(seq, t, joint, x, y, z): the joints' axis-angle vectors of usable files of ``min_frames`` and more, without the root."""
    frames = files.filter(F.col("problem").isNull() & (F.col("n") >= min_frames)).select("seq", F.posexplode("frames").alias("t", "f"))
    rows = frames.select("seq", "t", "f", F.explode(F.sequence(F.lit(0), F.lit(joints - 1))).alias("joint"))
    return rows.select("seq", "t", "joint", *[F.get("f", 3 + 3 * F.col("joint") + k).alias(c) for k, c in enumerate("xyz")])
