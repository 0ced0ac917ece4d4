"""Where each part sits in a stored keypoint row. Nothing else knows the offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.functions import arrays as A
from seqatlas.guards import InputError

# The declared row layout.
POSE_WIDTH, HANDS_WIDTH, FACE_WIDTH, MOUTH_WIDTH = 330, 252, 52, 36
ROW_WIDTH = POSE_WIDTH + HANDS_WIDTH + FACE_WIDTH + MOUTH_WIDTH
POSE_LANDMARKS, POSE_STRIDE, HAND_LANDMARKS, MOUTH_LANDMARKS = 33, 5, 21, 12
POSE_BLOCKS = (0, 165)
HANDS = {"left_norm": 0, "right_norm": 63, "left_world": 126, "right_world": 189}
MOUTH_CORNERS = (2, 3)
MASK = ("pose", "left_hand", "right_hand", "face")

# The older flat layout, with the hands last and a face mesh before them.
FLAT_HANDS, FLAT_FACE = 126, 468 * 3
POSE_POINT_WIDTHS = (4, 3)
POSE_POINT_RANGE = (10, 100)


def flat_hand(hands: Column, name: str) -> Column:
    return F.slice(hands, HANDS[name] + 1, 63)


def split_hands(hands: Column) -> tuple[Column, Column]:
    """Left and right hand as 21 landmarks each (normalised blocks)."""
    return tuple(A.reshape(flat_hand(hands, n), HAND_LANDMARKS) for n in ("left_norm", "right_norm"))


def pose_landmarks(pose: Column, world: bool = False) -> Column:
    return A.reshape(pose, POSE_LANDMARKS, stride=POSE_STRIDE, offset=POSE_BLOCKS[int(world)])


def mouth_landmarks(mouth: Column) -> Column:
    return A.reshape(mouth, MOUTH_LANDMARKS)


def concat_row(pose: Column, hands: Column, face: Column, mouth: Column, width: int = ROW_WIDTH) -> Column:
    """One feature row of all parts; NULL when the width is not the declared one."""
    row = F.concat(pose, hands, face, mouth)
    return F.when(F.size(row) == width, row)


def decode_declared(frames: DataFrame, *, wrist_hands: bool = True) -> DataFrame:
    """Add landmark columns left, right, pose and face to a stored frame table.

    Stored hands are wrist-centred, so by default the pose wrists stand for the hands
    and the head landmarks for the face; all parts then share one coordinate frame.
    """
    pose = A.where_valid(pose_landmarks(F.col("pose")), F.col("v_pose"))
    if wrist_hands:
        left, right = (A.wrist_as_hand(pose, w, HAND_LANDMARKS) for w in A.WRISTS)
    else:
        left, right = split_hands(F.col("hands"))
    out = {
        "left_points": A.where_valid(left, F.col("v_left")),
        "right_points": A.where_valid(right, F.col("v_right")),
        "pose_points": pose,
        "face_points": A.head_as_face(pose),
    }
    return frames.withColumns(out)


def _flat_points(row: Column, start: Column, count: Column, stride: int) -> Column:
    ks = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    return F.transform(
        ks, lambda k: F.transform(F.slice(row, start + k * stride + 1, 3), lambda v: v.cast("double"))
    )


def decode_flat(df: DataFrame, row: str) -> DataFrame:
    """Parts of a flat feature row by its width: hands are the last 126 values, a face
    mesh may precede them, what is left at the start is the pose."""
    width = F.size(row)
    flat = F.col(row)
    hands_at = width - FLAT_HANDS
    has_hands = width >= FLAT_HANDS
    face_at = hands_at - FLAT_FACE
    has_face = has_hands & (face_at >= 0)
    pose_width = F.when(has_face, face_at).otherwise(hands_at)
    pose = F.lit(None).cast("array<array<double>>")
    low, high = POSE_POINT_RANGE
    for stride in reversed(POSE_POINT_WIDTHS):
        points = F.floor(pose_width / stride).cast("int")
        fits = has_hands & (pose_width % stride == 0) & points.between(low, high)
        pose = F.when(fits, _flat_points(flat, F.lit(0), F.when(fits, points).otherwise(F.lit(0)), stride)).otherwise(pose)
    hand = lambda shift: F.when(has_hands, _flat_points(flat, hands_at + shift, F.lit(HAND_LANDMARKS), 3))
    return df.withColumns(
        {
            "left": hand(0),
            "right": hand(63),
            "face": F.when(has_face, _flat_points(flat, face_at, F.lit(468), 3)),
            "pose": pose,
        }
    )


def part_rows(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Long form of decoded parts: one row per landmark."""
    lost = [p for p in parts if p not in df.columns]
    if lost:
        raise InputError(f"parts not decoded: {lost}")
    stacked = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("points")) for p in parts])
    return (
        df.select(*keys, F.explode(stacked).alias("_p"))
        .select(*keys, "_p.part", F.posexplode("_p.points").alias("landmark", "_c"))
        .select(*keys, "part", "landmark", *[F.col("_c")[i].alias(a) for i, a in enumerate("xyz")])
    )


def mask_ratios(frames: DataFrame, keys: list[str], masks: dict[str, str]) -> DataFrame:
    """Share of valid frames per part and sequence; ``masks`` maps output to flag column."""
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_frames"),
        *[F.avg(F.col(flag).cast("double")).alias(name) for name, flag in masks.items()],
    )
