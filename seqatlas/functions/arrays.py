"""Keypoint arrays: landmarks, distances, angles, anchors and per-frame quality.

A landmark list is ``array<array<double>>`` (one [x, y, z] per landmark). The layout
module is the only place that knows where parts sit in a stored row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Small constants of the geometry.
ANGLE_EPS = 1e-6
POINT_EPS = 1e-8
CONFIDENCE = 0.5

# Landmark numbers of the hand and body models.
WRIST = 0
FINGERS = {
    "thumb": (1, 2, 3, 4),
    "index": (5, 6, 7, 8),
    "middle": (9, 10, 11, 12),
    "ring": (13, 14, 15, 16),
    "pinky": (17, 18, 19, 20),
}
NOSE, EARS, SHOULDERS, WRISTS, HIPS = 0, (7, 8), (11, 12), (15, 16), (23, 24)


def reshape(flat: Column, landmarks: int, stride: int = 3, offset: int = 0, coords: int = 3) -> Column:
    """Flat row to ``landmarks`` points of ``coords`` values; ``stride`` values per stored point."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(landmarks - 1)),
        lambda k: F.transform(F.slice(flat, k * stride + offset + 1, coords), lambda v: v.cast("double")),
    )


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` over named values that are evaluated once per row.

    A value used inside a lambda is otherwise computed anew for every element the lambda sees.
    """
    once = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(once, body), 1)


def point(landmarks: Column, index: int) -> Column:
    return F.element_at(landmarks, index + 1)


def where_valid(landmarks: Column, valid: Column) -> Column:
    return F.when(valid, landmarks)


def _total(values: Column, term: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + term(v))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def valid_row(flat: Column) -> Column:
    """All values finite and not all zero."""
    return F.forall(flat, lambda v: is_finite(v.cast("double"))) & (_total(flat, lambda v: F.abs(v.cast("double"))) > 0)


def valid_point(p: Column) -> Column:
    """All coordinates finite and the first two not at the origin."""
    flat_norm = F.sqrt(p[0] * p[0] + p[1] * p[1])
    return F.forall(p, is_finite) & (flat_norm > POINT_EPS)


def zero_point(p: Column) -> Column:
    return F.forall(p, lambda v: v == 0)


def missing_share(landmarks: Column) -> Column:
    """Share of points that are all zero."""
    return F.size(F.filter(landmarks, zero_point)) / F.size(landmarks)


def detected_share(landmarks: Column) -> Column:
    return F.size(F.filter(landmarks, lambda p: ~zero_point(p))) / F.size(landmarks)


def center(landmarks: Column) -> Column:
    """Mean of the valid points as struct<x,y,z>; NULL without a valid point."""
    good = F.filter(landmarks, valid_point)
    mean = lambda i: _total(good, lambda p: p[i]) / F.size(good)
    return F.when(F.size(good) > 0, F.struct(mean(0).alias("x"), mean(1).alias("y"), mean(2).alias("z")))


def invalid_point_share(landmarks: Column) -> Column:
    return 1 - F.size(F.filter(landmarks, valid_point)) / F.size(landmarks)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(a, lambda v: v * v))


def l2(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def step(a: Column, b: Column) -> Column:
    """Distance of two struct<x,y,z> points, NULL when either is."""
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at b in degrees."""
    ba, bc = subtract(a, b), subtract(c, b)
    cosine_ = dot(ba, bc) / (norm(ba) * norm(bc) + ANGLE_EPS)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_))))


def unit(v: Column) -> Column:
    length = norm(v) + ANGLE_EPS
    return F.transform(v, lambda x: x / length)


def cross(a: Column, b: Column) -> Column:
    return F.array(
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def hand_scale(hand: Column) -> Column:
    """Wrist to middle-finger base, plus a small constant."""
    return l2(point(hand, WRIST), point(hand, FINGERS["middle"][0])) + ANGLE_EPS


def axis_label(v: Column) -> Column:
    """Name of the dominant axis and its sign; the first axis wins ties."""
    x, y, z = F.abs(v[0]), F.abs(v[1]), F.abs(v[2])
    return (
        F.when((x >= y) & (x >= z), F.when(v[0] > 0, "right").otherwise("left"))
        .when(y >= z, F.when(v[1] > 0, "down").otherwise("up"))
        .otherwise(F.when(v[2] > 0, "forward").otherwise("backward"))
    )


def _has_content(landmarks: Column, eps: float) -> Column:
    return F.exists(landmarks, lambda p: F.exists(p, lambda v: F.abs(v) > eps))


def _middle(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) * 0.5)


def _anchored(landmarks: Column, anchor: Callable[[Column], Column], scale: Callable[[Column], Column], eps: float) -> Column:
    def moved(r: Column) -> Column:
        shifted = F.transform(r["points"], lambda p: F.zip_with(p, r["anchor"], lambda v, a: (v - a) / r["scale"]))
        return F.when(_has_content(r["points"], eps) & (r["scale"] > eps), shifted).otherwise(r["points"])

    return let(lambda outer: let(moved, points=outer["points"], anchor=anchor(outer["points"]), scale=scale(outer["points"])), points=landmarks)


def anchor_pose(
    landmarks: Column,
    shoulders: tuple[int, int] = SHOULDERS,
    ears: tuple[int, int] = EARS,
    eps: float = ANGLE_EPS,
) -> Column:
    """Origin at the neck, neck-to-head distance as unit; unchanged when undefined."""
    neck = lambda p: _middle(point(p, shoulders[0]), point(p, shoulders[1]))
    head = lambda p: _middle(point(p, ears[0]), point(p, ears[1]))
    return _anchored(landmarks, neck, lambda p: l2(head(p), neck(p)), eps)


def anchor_hand(hand: Column, eps: float = ANGLE_EPS) -> Column:
    """Origin at the wrist."""
    def moved(r: Column) -> Column:
        shifted = F.transform(r["hand"], lambda p: subtract(p, point(r["hand"], WRIST)))
        return F.when(_has_content(r["hand"], eps), shifted).otherwise(r["hand"])

    return let(moved, hand=hand)


def anchor_mouth(mouth: Column, left: int, right: int, eps: float = ANGLE_EPS) -> Column:
    """Origin between the lip corners, corner distance as unit."""
    return _anchored(
        mouth, lambda p: _middle(point(p, left), point(p, right)), lambda p: l2(point(p, right), point(p, left)), eps
    )


# --- the same on flat rows, as they are stored ---------------------------------------


def flat_step(a: Column, b: Column, points: int, stride: int = 3) -> Column:
    """Mean distance of corresponding points of two flat rows (plain columns, not expressions)."""
    d = lambda k, i: F.get(a, k * stride + i) - F.get(b, k * stride + i)
    apart = lambda k: F.sqrt(d(k, 0) * d(k, 0) + d(k, 1) * d(k, 1) + d(k, 2) * d(k, 2))
    return F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0.0), lambda s, k: s + apart(k)) / points


def anchor_flat_hand(hand: Column, eps: float = ANGLE_EPS) -> Column:
    """``anchor_hand`` of a flat row."""

    def moved(r: Column) -> Column:
        h = r["hand"]
        shifted = F.transform(h, lambda v, i: v - F.get(h, i % 3))
        return F.when(F.exists(h, lambda v: F.abs(v) > eps), shifted).otherwise(h)

    return let(moved, hand=hand)


def _flat_anchor(row: Column, start: int, width: int, stride: int, origin: tuple[int, int], reach: tuple[int, int] | None, eps: float) -> Column:
    """(shift, unit) of one block: an array of ``stride`` shifts and one of ``stride`` divisors.

    The origin lies between two points; the unit is the distance from there to the middle of ``reach``,
    or between the two points themselves. Blocks without content or unit are not moved.
    """
    at = lambda k, i: F.get(row, F.lit(start + k * stride + i))
    middle = lambda pair, i: (at(pair[0], i) + at(pair[1], i)) * 0.5
    gap = (lambda i: at(origin[1], i) - at(origin[0], i)) if reach is None else (lambda i: middle(reach, i) - middle(origin, i))
    rest = stride - 3

    def placed(r: Column) -> Column:
        ok = (r["unit"] > eps) & r["content"]
        shift = [F.when(ok, middle(origin, i)).otherwise(F.lit(0.0)) for i in range(3)] + [F.lit(0.0)] * rest
        unit = [F.when(ok, r["unit"]).otherwise(F.lit(1.0))] * 3 + [F.lit(1.0)] * rest
        return F.struct(F.array(*shift).alias("shift"), F.array(*unit).alias("unit"))

    content = F.size(F.filter(F.slice(row, start + 1, width), lambda v, i: (i % stride < 3) & (F.abs(v) > eps))) > 0
    return let(placed, unit=F.sqrt(gap(0) * gap(0) + gap(1) * gap(1) + gap(2) * gap(2)), content=content)


def _moved_blocks(row: Column, width: int, stride: int, starts: tuple[int, ...], anchors: Callable[[Column, int], Column]) -> Column:
    """Shift and scale every value of consecutive blocks in one pass."""

    def moved(r: Column) -> Column:
        place = lambda i: F.floor(i / width).cast("int") * stride + i % stride
        return F.transform(r["row"], lambda v, i: (v - F.get(r["shift"], place(i))) / F.get(r["unit"], place(i)))

    def bound(r: Column) -> Column:
        joined = lambda name: F.concat(*[r[f"a{s}"][name] for s in starts])
        return let(moved, row=r["row"], shift=joined("shift"), unit=joined("unit"))

    first = lambda r: let(bound, row=r["row"], **{f"a{s}": anchors(r["row"], s) for s in starts})
    return let(first, row=row)


def anchor_flat_pose(row: Column, starts: tuple[int, ...], width: int, stride: int = 5, eps: float = ANGLE_EPS) -> Column:
    """``anchor_pose`` of consecutive blocks in a flat row; the scores behind each point stay."""
    return _moved_blocks(row, width, stride, starts, lambda r, s: _flat_anchor(r, s, width, stride, SHOULDERS, EARS, eps))


def anchor_flat_mouth(row: Column, width: int, left: int, right: int, eps: float = ANGLE_EPS) -> Column:
    """``anchor_mouth`` of a flat row."""
    return _moved_blocks(row, width, 3, (0,), lambda r, s: _flat_anchor(r, s, width, 3, (left, right), None, eps))


def wrist_as_hand(pose: Column, wrist: int, copies: int = 21) -> Column:
    """A stand-in hand: the pose wrist repeated."""
    return F.array_repeat(point(pose, wrist), copies)


def head_as_face(pose: Column, landmarks: int = 11) -> Column:
    """A stand-in face: the head landmarks of the pose."""
    return F.slice(pose, 1, landmarks)


def pose_quality(landmarks: Column, visibility: Column) -> Column:
    """Box area, frontality, vertical tilt and shoulder angle of one frame's pose."""
    axis = lambda i: F.filter(F.transform(landmarks, lambda p: p[i]), lambda v: v > 0)
    xs, ys = axis(0), axis(1)
    seen = lambda k: F.element_at(visibility, k + 1) > CONFIDENCE
    (ls, rs), (lh, rh) = SHOULDERS, HIPS
    p = lambda k, i: point(landmarks, k)[i]
    off = lambda k: F.abs(p(k, 0) - 0.5)
    has_box = (F.size(xs) > 0) & (F.size(ys) > 0)
    both_shoulders = has_box & seen(ls) & seen(rs)
    all_four = both_shoulders & seen(lh) & seen(rh)
    symmetry = 1 - (F.abs(off(ls) - off(rs)) + F.abs(off(lh) - off(rh))) / 2
    area = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return F.struct(
        F.when(has_box, area).otherwise(F.lit(0.0)).alias("person_area"),
        F.when(all_four, F.greatest(F.lit(0.0), F.least(F.lit(1.0), symmetry))).otherwise(F.lit(0.5)).alias("frontality"),
        F.when(all_four, F.abs(p(ls, 1) - p(rs, 1)) + F.abs(p(lh, 1) - p(rh, 1))).otherwise(F.lit(0.0)).alias("tilt"),
        F.when(both_shoulders, F.degrees(F.atan2(p(rs, 1) - p(ls, 1), p(rs, 0) - p(ls, 0))))
        .otherwise(F.lit(0.0))
        .alias("shoulder_angle"),
    )


def hand_quality(points: Column, presence: Column) -> Column:
    """Share of visible keypoints and the area of their common box."""
    shown = F.filter(F.zip_with(points, presence, lambda p, c: (p[2] != 0) | (c > CONFIDENCE)), lambda seen: seen)
    axis = lambda i: F.transform(points, lambda p: p[i])
    span = lambda i: F.array_max(axis(i)) - F.array_min(axis(i))
    any_point = F.size(points) > 0
    return F.struct(
        any_point.alias("detected"),
        F.when(any_point, F.size(shown) / F.size(points)).otherwise(F.lit(0.0)).alias("visibility"),
        F.when(any_point, span(0) * span(1)).otherwise(F.lit(0.0)).alias("area"),
    )
