"""Pose conventions: the external one (camera looks +Z, world Y down) and ours (-Z, Z up).

S = diag(1, -1, -1) flips the camera frame, W maps the world (x, y, z) to (x, z, -y).
"""

from __future__ import annotations

from . import quat as Q
from . import vec as V

# S as a rotation: half a turn about X. W as a rotation: a quarter turn about -X.
_HALF_SQRT = 0.7071067811865476


def _s() -> Q.Quat:
    return Q.quat(0.0, 1.0, 0.0, 0.0)


def _w() -> Q.Quat:
    return Q.quat(_HALF_SQRT, -_HALF_SQRT, 0.0, 0.0)


def flip_translation(t: V.Vec) -> V.Vec:
    return (t[0], -t[1], -t[2])


def world_to_ours(p: V.Vec) -> V.Vec:
    return (p[0], p[2], -p[1])


def world_to_theirs(p: V.Vec) -> V.Vec:
    return (p[0], -p[2], p[1])


def pose_to_ours(q: Q.Quat, t: V.Vec) -> tuple[Q.Quat, V.Vec]:
    """R' = S R W^T, t' = S t."""
    return Q.mul(Q.mul(_s(), q), Q.conj(_w())), flip_translation(t)


def pose_to_theirs(q: Q.Quat, t: V.Vec) -> tuple[Q.Quat, V.Vec]:
    """R = S R' W, t = S t'."""
    return Q.mul(Q.mul(_s(), q), _w()), flip_translation(t)


def relative_pose(q: Q.Quat, t: V.Vec) -> tuple[Q.Quat, V.Vec]:
    """S R S, S t: its own inverse."""
    return Q.mul(Q.mul(_s(), q), _s()), flip_translation(t)


def flip_camera(q: Q.Quat, t: V.Vec) -> tuple[Q.Quat, V.Vec]:
    """S R, S t."""
    return Q.mul(_s(), q), flip_translation(t)
