"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import regex

SECRET = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(m) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return 12 <= len(digits) <= 19 and luhn(digits)


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), is_card),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def base(text: str | None, kinds) -> list[tuple[int, int, str, int]]:
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [(s, e, k, i) for s, i, k, e in sorted(found)]


def base_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ids_of(tok, text: str | None) -> list[int]:
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").lower().split()
    n = min(n, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_classes(rows: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """Row number -> smallest row number of its class, by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by: dict = {}
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for g in s:
            for j in by.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            by[g].append(i)
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        if not s:
            first = next(k for k in range(len(rows)) if not sets[k])
            a, b = sorted((find(i), find(first)))
            parent[b] = a
    return {i: find(i) for i in range(len(rows))}


def sanitised_spans(rows: list[tuple[int, str | None]], generalise: float = 0.75, remove: float = 0.9) -> list[str]:
    """Spans as of operator 10, row by row: every pair of entity and term counted by itself."""
    n, ents, words, terms = len(rows), [], [], []
    for _, t in rows:
        found = base(t, PERSONAL)
        ents.append({f"{k}:{t[s:e].lower()}" for s, e, k, _ in found})
        blank = list(t or "")
        for s, e, _, _ in found:
            blank[s:e] = " " * (e - s)
        words.append([(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]{2,}+", "".join(blank))])
        terms.append({m[0] for m in regex.finditer(r"[\p{L}\p{N}]{2,}+", (t or "").lower())})
    out = []
    for i, (_, t) in enumerate(rows):
        spans = [(s, k, e, name) for s, e, name, k in base(t, PERSONAL)]
        best: dict[str, float] = {}
        for c in ents[i]:
            having = [j for j in range(n) if c in ents[j]]
            p = len(having) / n
            if p == 1:
                continue
            for w in {w for _, _, w in words[i]}:
                n_ct = sum(w in {x for _, _, x in words[j]} for j in having)
                n_t = sum(w in terms[j] for j in range(n))
                if n_ct > 1 and n_t > 1:
                    share = math.log((n_ct - 1 + p) / n_t / p) / math.log(1 / p)
                    best[w] = max(best.get(w, -9.0), share)
        for s, e, w in words[i]:
            if best.get(w, -9.0) >= generalise:
                spans.append((s, 4, e, "removed") if best[w] >= remove else (s, 5, e, "generalised"))
        out.append(",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(spans)))
    return out


ALPHABETS = (("hex", r"[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"), ("base32", r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("upper36", r"[A-Z0-9]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower36", r"[a-z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
             *((name, "[A-Za-z0-9" + more.replace("-", r"\-") + "]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more)
               for name, more in (("base62", ""), ("base64", "+/"), ("url64", "-_"), ("any66", "+/-_"))))


def randomness(token: str) -> tuple[str, float]:
    """Encoding and test statistic of operator 8."""
    name, _, alphabet = next(a for a in ALPHABETS if re.fullmatch(a[1], token))
    x = [alphabet.find(c) for c in (token.lower() if name == "hex" else token)]
    n, k = len(x), len(alphabet)
    chi, df = sum((x.count(j) - n / k) ** 2 / (n / k) for j in range(k)), k - 1
    z1 = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [2 * v >= k for v in x]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    z2 = (runs - 2 * a * b / n - 1) / math.sqrt(max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9)) if a * b else 10.0
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    z3 = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var * math.sqrt(n) if var else 10.0
    return name, max(z1, 0) ** 2 + z2 ** 2 + z3 ** 2


def random_spans(texts: list[str | None], law, rate: float = 0.05, width: float = 0.25, ceiling: float = 16.27) -> list[list[tuple[int, int]]]:
    """Spans that Benjamini-Hochberg picks in each length class; ``law(class, encoding)`` is the sorted null sample."""
    tokens = [(i, m.start(), m.end(), *randomness(m[0]), math.floor(2 * math.log2(len(m[0]))))
              for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t or "") if re.search("[A-Za-z]", m[0])]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for cls in {x[5] for x in tokens}:
        mine, ps = [x for x in tokens if x[5] == cls], []
        for _, _, _, e, t, _ in mine:
            top = (math.floor(t / width) + 1) * width
            ps.append(1.0 if top > 66 * width else (sum(v <= top for v in law(cls, e)) + 1) / (len(law(cls, e)) + 1))
        order = sorted(p for p in ps if p < 1.0)
        cut = max([p for p in order if p * len(mine) <= rate * sum(q <= p for q in order)], default=0.0)
        for (i, s, e, _, t, _), p in zip(mine, ps):
            if p <= cut and t <= ceiling:
                out[i].append((s, e))
    return [sorted(x) for x in out]
