"""Pixel-format and colour conversions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, div255, idiv, shr


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma with 14-bit weights."""
    return shr(1868 * b + 9617 * g + 4899 * r + 8192, 14)


@dataclass(frozen=True)
class YuvStandard:
    """Fixed-point matrices of a YUV standard from its luma weights and ranges."""

    kr: float
    kb: float
    full: bool = False
    #: Red weight of the green-from-V term where the standard's table has another than kr.
    v_green_kr: float | None = None

    def _fixed(self, value, bits: int) -> int:
        v = np.float32(value)
        return int(np.float32(abs(v) * np.float32(1 << bits)) + np.float32(0.5)) * (1 if v >= 0 else -1)

    @property
    def y_low(self) -> int:
        return 0 if self.full else 16

    @property
    def back_bits(self) -> int:
        return 14 if self.full else 13

    def forward(self) -> dict[str, tuple[int, int, int]]:
        """(blue, green, red) weights of y, u and v in 14 bits."""
        one = np.float32(1)
        kr, kb = np.float32(self.kr), np.float32(self.kb)
        kg = one - kr - kb
        sy = one if self.full else np.float32(219) / np.float32(255)
        su = one if self.full else np.float32(224) / np.float32(255)
        half = np.float32(0.5)
        f = lambda v: self._fixed(v, 14)
        return {
            "y": (f(kb * sy), f(kg * sy), f(kr * sy)),
            "u": (f(half * su), f(-half * kg / (one - kb) * su), f(-half * kr / (one - kb) * su)),
            "v": (f(-half * kb / (one - kr) * su), f(-half * kg / (one - kr) * su), f(half * su)),
        }

    def backward(self) -> dict[str, int]:
        one, two = np.float32(1), np.float32(2)
        kr, kb = np.float32(self.kr), np.float32(self.kb)
        kg = one - kr - kb
        other = np.float32(self.v_green_kr if self.v_green_kr is not None else self.kr)
        sy = one if self.full else np.float32(255) / np.float32(219)
        su = one if self.full else np.float32(255) / np.float32(224)
        f = lambda v: self._fixed(v, self.back_bits)
        return {"y": f(sy), "ub": f(two * (one - kb) * su), "ug": f(-two * kb * (one - kb) / kg * su), "vg": f(-two * kr * (one - other) / kg * su), "vr": f(two * (one - kr) * su)}


STANDARDS = {
    "bt601": YuvStandard(0.299, 0.114),
    "bt709": YuvStandard(0.2126, 0.0722),
    "bt2020": YuvStandard(0.2627, 0.0593, v_green_kr=0.2126),
    "trect871": YuvStandard(0.299, 0.114, full=True),
}


def bgr_to_yuv(b: Column, g: Column, r: Column, standard: str = "bt601") -> dict[str, Column]:
    s = STANDARDS[standard]
    out = {}
    for name, (wb, wg, wr) in s.forward().items():
        out[name] = clamp(shr(wb * b + wg * g + wr * r + 8192, 14) + (s.y_low if name == "y" else 128))
    return out


def yuv_to_bgr(y: Column, u: Column, v: Column, standard: str = "bt601") -> dict[str, Column]:
    s = STANDARDS[standard]
    k, n = s.backward(), s.back_bits
    half = 1 << (n - 1)
    luma = k["y"] * (y - s.y_low)
    return {
        "b": clamp(shr(luma + k["ub"] * (u - 128) + half, n)),
        "g": clamp(shr(luma + k["ug"] * (u - 128) + k["vg"] * (v - 128) + half, n)),
        "r": clamp(shr(luma + k["vr"] * (v - 128) + half, n)),
    }


def _extremes(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    return top, low, top - low


def hue(b: Column, g: Column, r: Column) -> Column:
    """Hue of 255 steps; 0 for gray."""
    top, _, span = _extremes(b, g, r)
    part = F.when(r == top, g - b + 6 * span).when(g == top, b - r + 2 * span).otherwise(r - g + 4 * span)
    return F.when(span == 0, F.lit(0)).otherwise(idiv(part * 85, 2 * span)) % 256


def bgr_to_hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    top, _, span = _extremes(b, g, r)
    return {"h": hue(b, g, r), "s": F.when(top == 0, F.lit(0)).otherwise(idiv(255 * span, F.greatest(top, F.lit(1)))), "v": top}


def bgr_to_hsl(b: Column, g: Column, r: Column) -> dict[str, Column]:
    top, low, span = _extremes(b, g, r)
    total = top + low
    s = F.when((total == 0) | (total == 510), F.lit(0)).when(total <= 255, idiv(255 * span, F.greatest(total, F.lit(1)))).otherwise(idiv(255 * span, F.greatest(510 - total, F.lit(1))))
    return {"h": hue(b, g, r), "s": s, "l": idiv(total, 2)}


def int16_to_gray(v: Column) -> Column:
    return clamp(v)


def premultiply(v: Column, alpha: Column) -> Column:
    return div255(v * alpha)


def unpremultiply(v: Column, alpha: Column) -> Column:
    """v * 255 / alpha, at most 255; 0 where alpha is 0."""
    return F.when(alpha == 0, F.lit(0)).otherwise(F.least(F.floor(v * F.lit(255.00001) / F.greatest(alpha, F.lit(1))), F.lit(255))).cast("long")


#: Position (y % 2, x % 2) -> channel of each Bayer mosaic.
BAYER = {
    "grbg": (("g", "r"), ("b", "g")),
    "gbrg": (("g", "b"), ("r", "g")),
    "rggb": (("r", "g"), ("g", "b")),
    "bggr": (("b", "g"), ("g", "r")),
}


def bayer(b: Column, g: Column, r: Column, y: Column, x: Column, mosaic: str) -> Column:
    pick = {"b": b, "g": g, "r": r}
    (tl, tr), (bl, br) = BAYER[mosaic]
    return F.when((y % 2 == 0) & (x % 2 == 0), pick[tl]).when(y % 2 == 0, pick[tr]).when(x % 2 == 0, pick[bl]).otherwise(pick[br])


def uint8_to_float(v: Column, lower: float, upper: float) -> Column:
    return v * F.lit((upper - lower) / 255.0) + F.lit(lower)


def float_to_uint8(v: Column, lower: float, upper: float) -> Column:
    """Clamp, scale to 0..255, truncate."""
    return F.floor((F.least(F.greatest(v, F.lit(lower)), F.lit(upper)) - lower) * F.lit(255.0 / (upper - lower))).cast("long")


def boosted_uv(v: Column, boost: int) -> Column:
    low = 128 - 128 // boost
    return (clamp(v, low, 255 - low) - low) * boost
