"""Seeds, a portable random stream and character banks. Small numbers of values, made on the driver or within one group."""
from __future__ import annotations

import hashlib
import math

_M = (1 << 64) - 1

# Fixed values of the seed format: what a derived seed is for.
DOMAINS = {
    "graph_latent": 0x243F6A8885A308D3,
    "graph_sampling": 0x13198A2E03707344,
    "robustness": 0xA4093822299F31D0,
    "character_bank": 0x082EFA98EC4E6C89,
    "cross_observation": 0x452821E638D01377,
    "scalability": 0xBE5466CF34E90C6C,
}


def splitmix64(x: int) -> int:
    """The finaliser of Steele, Lea and Flood's SplitMix after one step of its Weyl sequence."""
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def derive_seed(base: int, domain: int, coordinates: tuple[int, ...] = ()) -> int:
    """A seed that depends on the order and the number of the coordinates."""
    # fixed values of the seed format: stride of positions, tag of the number of coordinates
    stride, arity = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
    state = splitmix64(splitmix64(base & _M) ^ domain)
    for at, c in enumerate(coordinates, 1):
        state = splitmix64(state ^ splitmix64((c & _M) ^ stride * at & _M))
    return splitmix64(state ^ splitmix64(len(coordinates) ^ arity))


def signed(seed: int) -> int:
    """The same 64 bits as a signed number, as a long column holds them; the stream takes either."""
    return seed - (1 << 64) if seed >> 63 else seed


def named_seed(*parts: str, bits: int = 32) -> int:
    """A seed from text parts, each preceded by its length, by blake2b."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        raw = p.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return int.from_bytes(h.digest(), "big") & (1 << bits) - 1


class Twister:
    """The 64-bit Mersenne Twister of Nishimura and Matsumoto, and draws made from it."""

    def __init__(self, seed: int):
        s = [seed & _M]
        for i in range(1, 312):
            s.append(6364136223846793005 * (s[-1] ^ s[-1] >> 62) + i & _M)
        self.state, self.at, self.spare = s, 312, None

    def word(self) -> int:
        if self.at == 312:
            s, low = self.state, (1 << 31) - 1
            for i in range(312):
                y = s[i] & ~low & _M | s[(i + 1) % 312] & low
                s[i] = s[(i + 156) % 312] ^ y >> 1 ^ (0xB5026F5AA96619E9 if y & 1 else 0)
            self.at = 0
        x = self.state[self.at]
        self.at += 1
        x ^= x >> 29 & 0x5555555555555555
        x ^= x << 17 & 0x71D67FFFEDA60000
        x ^= x << 37 & 0xFFF7EEE000000000
        return x ^ x >> 43

    def closed(self) -> float:
        """In [0, 1)."""
        return (self.word() >> 11) / 2.0**53

    def open(self) -> float:
        """In (0, 1)."""
        return ((self.word() >> 11) + 0.5) / 2.0**53

    def below(self, n: int) -> int:
        """Uniform in [0, n), by rejection."""
        least = (_M + 1 - n) % n
        while (x := self.word()) < least:
            pass
        return x % n

    def between(self, lo: int, hi: int) -> int:
        return lo + self.below(hi - lo + 1)

    def weighted(self, weights, u: float | None = None) -> int:
        """Index drawn in proportion to the weights."""
        left = (self.closed() if u is None else u) * math.fsum(weights)
        for i, w in enumerate(weights):
            left -= w
            if left < 0:
                return i
        return len(weights) - 1

    def normal(self) -> float:
        """Box-Muller; the sine half is kept for the next call."""
        if self.spare is not None:
            x, self.spare = self.spare, None
            return x
        r, a = math.sqrt(-2 * math.log(self.open())), 2 * math.pi * self.open()
        self.spare = r * math.sin(a)
        return r * math.cos(a)

    def shuffle(self, items: list) -> list:
        """A shuffled copy, by Fisher and Yates."""
        x = list(items)
        for i in range(len(x) - 1, 0, -1):
            j = self.below(i + 1)
            x[i], x[j] = x[j], x[i]
        return x


def character_bank(n: int, seed: int) -> list[tuple[int, float, float, float, float]]:
    """(idx, lb, ld, rb, rd): standard normal frequencies; a smaller bank is the beginning of a larger one."""
    t = Twister(seed)
    return [(i, *(t.normal() for _ in range(4))) for i in range(n)]


def feature_sizes(k: int) -> list[int]:
    """Harmonic coordinates of the four families for k features, of which 4 are statistics; the first families get the remainder."""
    n = max(0, k - 4)
    return [n // 4 + (i < n % 4) for i in range(4)]


def pick(j: int, family: int, bank: int) -> tuple[int, str]:
    """(character, side) of coordinate j of a family: the bank's 2 x bank frequency pairs, spread evenly over the family."""
    q, r = divmod(j * bank, family)
    return q, "right" if r >= (family + 1) // 2 else "left"


FAMILIES = ("linear", "weighted_linear", "relationship", "weighted_relationship")
STATISTICS = ("mass", "weighted_mass", "relationship_mass", "weighted_relationship_mass")


def feature_spec(bank: list[tuple], k: int, families: tuple[str, ...] = FAMILIES, statistics: tuple[str, ...] = STATISTICS, sizes: list[int] | None = None) -> list[tuple[int, str, float, float]]:
    """(idx, family, w0, w1) of each of k features; a statistic has the frequency 0."""
    if k <= len(statistics):
        return [(i, s, 0.0, 0.0) for i, s in enumerate(statistics[:k])]
    out = []
    for family, n in zip(families, sizes or feature_sizes(k), strict=True):
        for j in range(n):
            c, side = pick(j, n, len(bank))
            _, lb, ld, rb, rd = bank[c]
            out.append((len(out), family, *((lb, ld) if side == "left" else (rb, rd))))
    return out + [(len(out) + i, s, 0.0, 0.0) for i, s in enumerate(statistics)]


def linear_spec(bank: list[tuple], k: int) -> list[tuple[int, str, float, float]]:
    """The layout without relationships: half of k - 2 coordinates, rounded up, are linear, the others weighted; then two masses."""
    n = max(0, k - 2)
    return feature_spec(bank, k, FAMILIES[:2], STATISTICS[:2], [(n + 1) // 2, n // 2])
