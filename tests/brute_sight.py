"""What is seen from a point, with arrays: what the tests hold the columns of strideway.operators.sight against."""

from __future__ import annotations

import math

import numpy as np

RAYS = 72


def ray_directions(rays: int = RAYS) -> tuple[np.ndarray, np.ndarray]:
    angle = np.arange(rays) * (2 * math.pi / rays)
    return np.cos(angle), np.sin(angle)


def wall_hits(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Distance along each ray from the origin to each segment (a row for each); inf where it isn't hit."""
    rx, ry = ray_directions()
    sx, sy = (bx - ax)[:, None], (by - ay)[:, None]
    cross = rx * sy - ry * sx
    apart = np.abs(cross) > 1e-12
    cross = np.where(apart, cross, 1.0)
    t = (ax[:, None] * sy - ay[:, None] * sx) / cross
    u = (ax[:, None] * ry - ay[:, None] * rx) / cross
    return np.where(apart & (t >= 0) & (u >= 0) & (u <= 1), t, np.inf)


def star_overlaps(reach: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Signed area that each side's triangle with the origin shares with a star-shaped region around it.

    ``reach``: for each side the region's distance along each ray. Summed over a polygon's sides the absolute value is
    the common area. Each side is cut at the rays; between two rays both the side and the region's border are straight.
    """
    sign = np.sign(ax * by - ay * bx)
    flip = sign < 0
    ax, bx, ay, by = np.where(flip, bx, ax), np.where(flip, ax, bx), np.where(flip, by, ay), np.where(flip, ay, by)
    cx, cy = ray_directions()
    nx, ny = np.roll(cx, -1), np.roll(cy, -1)
    far = np.roll(reach, -1, axis=1)
    dx, dy = (bx - ax)[:, None], (by - ay)[:, None]
    px, py = ax[:, None], ay[:, None]
    left0, left1 = cx * py - cy * px, cx * dy - cy * dx  # left of the first ray: left0 + t left1 >= 0
    right0, right1 = ny * px - nx * py, ny * dx - nx * dy  # right of the second
    low, high = np.zeros(left0.shape), np.ones(left0.shape)
    for base, slope in ((left0, left1), (right0, right1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            at = -base / slope
        low = np.where(slope > 0, np.maximum(low, at), low)
        high = np.where(slope < 0, np.minimum(high, at), high)
        high = np.where((slope == 0) & (base < 0), -1.0, high)
    open_ = high > low
    low, high = np.where(open_, low, 0.0), np.where(open_, high, 0.0)
    ux, uy, vx, vy = px + low * dx, py + low * dy, px + high * dx, py + high * dy
    sx, sy, ex, ey = reach * cx, reach * cy, far * nx, far * ny
    # inside of the border: g >= 0, with g0 at the origin
    g0 = sx * ey - sy * ex
    gu = (ex - sx) * (uy - sy) - (ey - sy) * (ux - sx)
    gv = (ex - sx) * (vy - sy) - (ey - sy) * (vx - sx)
    cut = lambda g: g0 / np.where(g0 - g > 0, g0 - g, 1.0)
    su, sv = np.where(gu >= 0, 1.0, cut(gu)), np.where(gv >= 0, 1.0, cut(gv))
    share = gu / np.where(gu != gv, gu - gv, 1.0)
    mx, my = ux + share * (vx - ux), uy + share * (vy - uy)
    crossed = (gu >= 0) != (gv >= 0)
    tri = lambda ax, ay, bx, by: (ax * by - ay * bx) / 2
    plain = tri(ux * su, uy * su, vx * sv, vy * sv)
    bent = tri(ux * su, uy * su, mx, my) + tri(mx, my, vx * sv, vy * sv)
    return sign * np.where(open_, np.maximum(np.where(crossed, bent, plain), 0.0), 0.0).sum(axis=1)
