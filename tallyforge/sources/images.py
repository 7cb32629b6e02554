"""Binary images of summaries, for exchange with other libraries.

Layouts are fixed values (offsets, family numbers, flags), little-endian throughout. Each pair of
functions is plain Python over one summary; map them over a BINARY column where there are many.
Items are given as bytes by an item codec: longs, doubles, or strings with a length before each.
"""

from __future__ import annotations

import struct

import numpy as np

from tallyforge.kernels.quantile import Kll

from tallyforge.kernels.hashing import SEED, seed_hash

__all__ = ["ITEMS", "bloom_from_image", "bloom_image", "count_min_from_image", "count_min_image", "frequency_from_image", "frequency_image", "reservoir_from_image", "reservoir_image", "theta_to_image", "tuple_from_image", "tuple_image", "varopt_from_image", "varopt_image"]

#: Family numbers.
THETA, TUPLE, FREQUENCY, RESERVOIR, VAROPT, COUNT_MIN, BLOOM = 3, 9, 10, 11, 13, 18, 21
_TOP = (1 << 63) - 1


def _longs_out(items) -> bytes:
    return np.asarray(items, "<i8").tobytes()


def _longs_in(data: bytes, at: int, n: int) -> tuple[list, int]:
    return np.frombuffer(data, "<i8", n, at).tolist(), at + 8 * n


def _doubles_out(items) -> bytes:
    return np.asarray(items, "<f8").tobytes()


def _doubles_in(data: bytes, at: int, n: int) -> tuple[list, int]:
    return np.frombuffer(data, "<f8", n, at).tolist(), at + 8 * n


def _strings_out(items) -> bytes:
    raw = [s.encode() for s in items]
    return b"".join(struct.pack("<I", len(r)) + r for r in raw)


def _strings_in(data: bytes, at: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out, at


ITEMS = {"long": (_longs_out, _longs_in), "double": (_doubles_out, _doubles_in), "string": (_strings_out, _strings_in)}


def _expect(data: bytes, version: int, family: int) -> None:
    if len(data) < 8 or data[1] != version or data[2] != family:
        raise ValueError("not an image of this family and version")


def theta_to_image(theta: int, hashes, seed: int = SEED) -> bytes:
    """A plain (version 3), ordered, compact image, which Spark's theta functions read."""
    h = np.sort(np.asarray(hashes, np.int64)).astype("<i8")
    empty, exact = len(h) == 0 and theta == _TOP, theta == _TOP
    longs = 1 if empty or (exact and len(h) == 1) else 2 if exact else 3
    # read-only 2, empty 4, compact 8, ordered 16, single 32
    flags = 2 | 8 | 16 | (4 if empty else 0) | (32 if longs == 1 and not empty else 0)
    out = struct.pack("<BBBBBBH", longs, 3, THETA, 0, 0, flags, seed_hash(seed))
    if longs > 1:
        out += struct.pack("<If", len(h), 1.0)
    if longs > 2:
        out += struct.pack("<q", theta)
    return out + h.tobytes()


def theta_packed_image(theta: int, hashes, seed: int = SEED) -> bytes:
    """A compressed (version 4) image: the steps between hashes in order, in as many bits each as the greatest needs.

    A sketch without hashes, or with one alone in exact mode, gets the plain image.
    """
    h = np.sort(np.asarray(hashes, np.int64))
    if len(h) == 0 or (len(h) == 1 and theta == _TOP):
        return theta_to_image(theta, h, seed)
    steps = np.diff(h, prepend=0)
    bits, size = int(steps.max()).bit_length(), max(1, -(-len(h).bit_length() // 8))
    body = np.packbits(np.unpackbits(steps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :]).tobytes()
    exact = theta == _TOP
    head = struct.pack("<BBBBBBH", 1 if exact else 2, 4, THETA, bits, size, 2 | 8 | 16, seed_hash(seed))
    return head + (b"" if exact else struct.pack("<q", theta)) + len(h).to_bytes(size, "little") + body


def tuple_image(theta: int, entries: list[tuple[int, list[float]]], values: int, seed: int = SEED) -> bytes:
    """Compact entries of a hash and an array of doubles each, ordered by hash."""
    rows = sorted(entries)
    empty, exact = not rows and theta == _TOP, theta == _TOP
    longs = 1 if empty or (exact and len(rows) == 1) else 2 if exact else 3
    flags = 2 | 8 | 16 | (4 if empty else 0)
    out = struct.pack("<BBBBBBH", longs, 3, TUPLE, 1, 0, flags, seed_hash(seed))
    if longs > 1:
        out += struct.pack("<II", len(rows), 0)
    if longs > 2:
        out += struct.pack("<q", theta)
    body = np.empty(len(rows), [("h", "<i8"), ("v", "<f8", (values,))])
    if rows:
        body["h"] = [h for h, _ in rows]
        body["v"] = [v for _, v in rows]
    return out + body.tobytes()


def tuple_from_image(data: bytes, values: int, seed: int = SEED) -> tuple[int, list[tuple[int, list[float]]]]:
    _expect(data, 3, TUPLE)
    longs, flags = data[0], data[5]
    if struct.unpack_from("<H", data, 6)[0] != seed_hash(seed):
        raise ValueError("the image was made with another seed")
    if flags & 4:
        return _TOP, []
    n = struct.unpack_from("<I", data, 8)[0] if longs > 1 else 1
    theta = struct.unpack_from("<q", data, 16)[0] if longs > 2 else _TOP
    body = np.frombuffer(data, [("h", "<i8"), ("v", "<f8", (values,))], n, 8 * longs)
    return theta, list(zip(body["h"].tolist(), body["v"].reshape(n, values).tolist(), strict=True))


def frequency_image(counts: dict, offset: int, weight: int, lg_max: int, items: str = "long") -> bytes:
    lg_now = max(3, (len(counts) * 4 // 3).bit_length())
    if not counts:
        return struct.pack("<BBBBBBxx", 1, 1, FREQUENCY, lg_max, lg_now, 5)
    head = struct.pack("<BBBBBBxxIxxxxqq", 4, 1, FREQUENCY, lg_max, lg_now, 0, len(counts), weight, offset)
    return head + _longs_out(list(counts.values())) + ITEMS[items][0](list(counts))


def frequency_from_image(data: bytes, items: str = "long") -> tuple[dict, int, int]:
    """(counters, offset, stream weight)."""
    _expect(data, 1, FREQUENCY)
    if data[5] & 5:
        return {}, 0, 0
    n, weight, offset = struct.unpack_from("<Ixxxxqq", data, 8)
    counts, at = _longs_in(data, 32, n)
    names, _ = ITEMS[items][1](data, at, n)
    return dict(zip(names, counts, strict=True)), offset, weight


def count_min_image(cells: np.ndarray, total: float, seed: int = SEED) -> bytes:
    """cells: hashes by buckets."""
    hashes, buckets = cells.shape
    empty = total == 0
    out = struct.pack("<BBBBIIBHB", 2, 1, COUNT_MIN, int(empty), 0, buckets, hashes, seed_hash(seed), 0)
    return out if empty else out + struct.pack("<q", int(total)) + np.asarray(cells, "<i8").tobytes()


def count_min_from_image(data: bytes, seed: int = SEED) -> tuple[np.ndarray, int]:
    _expect(data, 1, COUNT_MIN)
    buckets, hashes, own, _ = struct.unpack_from("<IBHB", data, 8)
    if own != seed_hash(seed):
        raise ValueError("the image was made with another seed")
    if data[3] & 1:
        return np.zeros((hashes, buckets), np.int64), 0
    (total,) = struct.unpack_from("<q", data, 16)
    return np.frombuffer(data, "<i8", hashes * buckets, 24).reshape(hashes, buckets).copy(), total


def bloom_image(bits: list[int], size: int, hashes: int, seed: int = SEED) -> bytes:
    """bits: the set ones; size: of the filter, a multiple of 64."""
    head = struct.pack("<BBBBHxxQIxxxx", 4 if bits else 3, 1, BLOOM, 0 if bits else 4, hashes, seed, size // 64)
    if not bits:
        return head
    flat = np.zeros(size, np.uint8)
    flat[bits] = 1
    return head + struct.pack("<Q", len(bits)) + np.packbits(flat, bitorder="little").tobytes()


def bloom_from_image(data: bytes) -> tuple[list[int], int, int, int]:
    """(set bits, size, hashes, seed)."""
    _expect(data, 1, BLOOM)
    hashes, seed, longs = struct.unpack_from("<HxxQI", data, 4)
    if data[3] & 4:
        return [], 64 * longs, hashes, seed
    flat = np.unpackbits(np.frombuffer(data, np.uint8, 8 * longs, 32), bitorder="little")
    return np.flatnonzero(flat).tolist(), 64 * longs, hashes, seed


def reservoir_image(sample: list, k: int, n: int, items: str = "long") -> bytes:
    # resize factor 8 in the top two bits
    if not n:
        return struct.pack("<BBBBI", 0xC0 | 1, 2, RESERVOIR, 4, k)
    return struct.pack("<BBBBIQ", 0xC0 | 2, 2, RESERVOIR, 0, k, n) + ITEMS[items][0](sample)


def reservoir_from_image(data: bytes, items: str = "long") -> tuple[list, int, int]:
    """(sample, k, items seen)."""
    _expect(data, 2, RESERVOIR)
    (k,) = struct.unpack_from("<I", data, 4)
    if data[3] & 4:
        return [], k, 0
    (n,) = struct.unpack_from("<Q", data, 8)
    return ITEMS[items][1](data, 16, min(n, k))[0], k, n


def varopt_image(heavy: list[tuple], light: list, light_weight: float, k: int, n: int, items: str = "long") -> bytes:
    """heavy: (item, weight) pairs; light: items that share light_weight in all."""
    if not n:
        return struct.pack("<BBBBI", 0xC0 | 1, 2, VAROPT, 4, k)
    heavy = sorted(heavy, key=lambda x: x[1])
    out = struct.pack("<BBBBIQII", 0xC0 | (4 if light else 3), 2, VAROPT, 0, k, n, len(heavy), len(light))
    if light:
        out += struct.pack("<d", light_weight)
    out += _doubles_out([w for _, w in heavy])
    put = ITEMS[items][0]
    return out + put([x for x, _ in heavy]) + (put(light) if light else b"")


def varopt_from_image(data: bytes, items: str = "long") -> tuple[list[tuple], list, float, int, int]:
    """(heavy pairs, light items, their weight in all, k, items seen)."""
    _expect(data, 2, VAROPT)
    (k,) = struct.unpack_from("<I", data, 4)
    if data[3] & 4:
        return [], [], 0.0, k, 0
    n, h, r = struct.unpack_from("<QII", data, 8)
    at, total = 24, 0.0
    if r:
        (total,) = struct.unpack_from("<d", data, at)
        at += 8
    weights, at = _doubles_in(data, at, h)
    get = ITEMS[items][1]
    names, at = get(data, at, h)
    light, _ = get(data, at, r) if r else ([], at)
    return list(zip(names, weights, strict=True)), light, total, k, n


_HLL_TYPES = {4: 0, 6: 1, 8: 2}
_ADDRESS = (1 << 26) - 1


def _registers_of(coupons: np.ndarray, lg_k: int) -> np.ndarray:
    out = np.zeros(1 << lg_k, np.uint8)
    np.maximum.at(out, coupons & _ADDRESS & ((1 << lg_k) - 1), (coupons >> 26).astype(np.uint8))
    return out


def hll_from_image(data: bytes) -> dict:
    """lg_k, bits (4, 6 or 8 a register), registers, and the running (HIP) estimate, None after merges or below registers.

    Lists and sets of coupons become the registers that they stand for.
    """
    _expect(data, 1, 7)
    lg_k, flags, mode = data[3], data[5], data[7] & 3
    bits = (4, 6, 8)[data[7] >> 2 & 3]
    out = {"lg_k": lg_k, "bits": bits, "hip": None}
    if flags & 4:
        return out | {"registers": np.zeros(1 << lg_k, np.uint8), "hip": 0.0}
    if mode < 2:
        n, at = (data[6], 8) if mode == 0 else (int.from_bytes(data[8:12], "little"), 12)
        held = np.frombuffer(data, "<u4", n if flags & 8 else 1 << data[4], at)
        return out | {"registers": _registers_of(held[held > 0].astype(np.int64), lg_k)}
    hip, _, _, _, n_aux = struct.unpack_from("<dddii", data, 8)
    k = 1 << lg_k
    if bits == 8:
        r = np.frombuffer(data, np.uint8, k, 40).copy()
    elif bits == 6:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, k * 3 // 4, 40), bitorder="little").reshape(k, 6)
        r = np.packbits(flat, axis=1, bitorder="little").ravel()
    else:
        two = np.frombuffer(data, np.uint8, k // 2, 40)
        r = np.stack([two & 15, two >> 4], axis=1).ravel()
        above = r == 15
        r = r + np.uint8(data[6])
        size = n_aux if flags & 8 else 1 << data[4]
        aux = np.frombuffer(data, "<u4", size, 40 + k // 2)
        aux = aux[aux > 0].astype(np.int64)
        r[above] = 0
        r[aux & _ADDRESS & (k - 1)] = aux >> 26
    return out | {"registers": r, "hip": None if flags & 16 else hip}


def hll_image(registers: np.ndarray, bits: int = 8, estimate: float | None = None) -> bytes:
    """Registers as an image of 4, 6 or 8 bits each; without an estimate it is marked as merged."""
    r = np.asarray(registers, np.uint8)
    k = len(r)
    if not r.any():
        return struct.pack("<8B", 2, 1, 7, k.bit_length() - 1, 3, 4 | 8, 0, _HLL_TYPES[bits] << 2)
    low = int(r.min()) if bits == 4 else 0
    terms = np.ldexp(1.0, -r.astype(np.int64))
    aux = np.zeros(0, np.int64)
    if bits == 8:
        body = r.tobytes()
    elif bits == 6:
        flat = np.unpackbits(r[:, None], axis=1, count=6, bitorder="little")
        body = np.packbits(flat, bitorder="little").tobytes() + b"\0"
    else:
        over = r - low
        aux = np.flatnonzero(over > 14)
        over = np.minimum(over, 15).reshape(-1, 2)
        body = (over[:, 0] | over[:, 1] << 4).astype(np.uint8).tobytes() + (aux | r[aux].astype(np.int64) << 26).astype("<u4").tobytes()
    lg_aux = max(2, int(np.ceil(np.log2(max(1, len(aux)) * 4 / 3)))) if bits == 4 else 0
    head = struct.pack("<8B", 10, 1, 7, k.bit_length() - 1, lg_aux, 8 | (16 if estimate is None else 0), low, 2 | _HLL_TYPES[bits] << 2)
    return head + struct.pack("<dddii", estimate or 0.0, float(terms[r < 32].sum()), float(terms[r >= 32].sum()), int((r == low).sum()), len(aux)) + body


def _kll_room(k: int, levels: int, m: int = 8) -> int:
    """Items that so many levels have room for: k at the top, two thirds of it one below, and so on, m at least."""
    return sum(max(m, ((2 * k << d) // 3**d + 1) // 2) for d in range(levels))


def kll_image(s: Kll) -> bytes:
    """A summary of doubles; levels lie one after the other, lowest first."""
    if s.n == 0:
        return struct.pack("<4BHBx", 2, 1, 15, 1, s.k, 8)
    levels = [sorted(x) for x in s.levels]
    if s.n == 1:
        return struct.pack("<4BHBxd", 2, 2, 15, 4, s.k, 8, levels[0][0])
    sizes = [len(x) for x in levels]
    while (room := _kll_room(s.k, len(sizes))) < sum(sizes):
        sizes.append(0)
    at = room - sum(sizes) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    head = struct.pack("<4BHBxqHBx", 5, 1, 15, 2, s.k, 8, s.n, s.min_k, len(sizes))
    return head + at.astype("<i4").tobytes() + struct.pack("<dd", s.low, s.high) + np.array([x for level in levels for x in level], "<f8").tobytes()


def kll_from_image(data: bytes) -> Kll:
    if data[2] != 15 or data[1] not in (1, 2):
        raise ValueError("not a summary of quantiles")
    k, flags = struct.unpack_from("<H", data, 4)[0], data[3]
    out = Kll(k)
    if flags & 1:
        return out
    if flags & 4:
        return out.extend(struct.unpack_from("<d", data, 8))
    out.n, out.min_k, levels = struct.unpack_from("<qHB", data, 8)
    at = np.frombuffer(data, "<i4", levels, 20)
    out.low, out.high = struct.unpack_from("<dd", data, 20 + 4 * levels)
    items = np.frombuffer(data, "<f8", offset=36 + 4 * levels)
    ends = [*(at[1:] - at[0]).tolist(), len(items)]
    out.levels = [items[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    return out
