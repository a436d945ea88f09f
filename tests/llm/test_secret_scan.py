import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from marlpit.llm.secret_scan import CLASSES, UUID, joined, redact, redacted, scan_secrets, secret_spans, widened, window_entropies

BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(k, m.start(), m.end()) for k, (form, keep) in BASE.items() for m in form.finditer(text) if keep(m)]
    return sorted(found, key=lambda x: (x[1], list(BASE).index(x[0])))


def noise(rng):
    parts = ["password", "Token", "API_KEY", "secret", "ſecret", " ", "=", ":", '"', "'", "abc", "deadbeef" * 4, "AKIA", "AKIA" + "Z9" * 8, "x", "é", "\n", "0f" * 11, "q1W2e3R4t5", "."]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(30)))


def test_base_spans_match_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        text = noise(rng)
        spans = secret_spans(text)
        assert [x for x in spans if x[0] != "entropy"] == brute(text), text


def test_incremental_entropy_matches_definition():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh0123XYZ") for _ in range(80))
    want = [-sum(c / 20 * math.log2(c / 20) for c in Counter(text[k : k + 20]).values()) for k in range(61)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(window_entropies(text), want, strict=True))


def entropy(window):
    return -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())


def least(string):
    return next(bits for _, form, bits in CLASSES if form.fullmatch(string))


def public(string):
    """The allow-list in words: a UUID, no digit but a separator, numbers, a short piece five times over, a sample."""
    wordy = not any(c.isdigit() for c in string) and any(c in "+/_=-" for c in string)
    numbers = all(c in "0123456789+/_=-" for c in string)
    repeats = any(string[: w * 5] == string[:w] * 5 and (string[:w] * len(string))[: len(string) - r] == string[: len(string) - r] and (len(string) - r) % w == 0 for w in range(1, 5) for r in range(4) if len(string) - r >= 5 * w)
    samples = ("EXAMPLE", "example", "XXXX", "xxxx", "0123456789", "abcdefghij", "ABCDEFGHIJ")
    return bool(wordy or numbers or repeats or any(x in string for x in samples) or UUID.fullmatch(string))


def brute_windows(text, start, end, separators, taken):
    """Windows that pass, hold a separator and meet nothing taken, as unions of those that meet or touch."""
    if end - start < 20 or public(text[start:end]):
        return []
    bits, out = least(text[start:end]), []
    for at in range(start, end - 19):
        window = text[at : at + 20]
        if entropy(window) >= bits - 1e-9 and any(c in separators for c in window) and not any(a < at + 20 and at < b for a, b in taken):
            if out and at <= out[-1][1]:
                out[-1] = (out[-1][0], at + 20)
            else:
                out.append((at, at + 20))
    return out


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def brute_entropy_spans(text):
    found = []
    for candidate in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        low, high = candidate.span()
        uuids = [m.span() for m in UUID.finditer(text, low, high)]
        keys = []
        for m in re.finditer("[0-9A-Za-z]{20,}", text[low:high]):
            part = m[0]
            windows = [part[k : k + 20] for k in range(len(part) - 19)]
            if least(part) < math.inf and not public(part) and any(entropy(w) >= min(least(part), least(w)) - 1e-9 for w in windows):
                keys.append((low + m.start(), low + m.end(), part != part.lower() and part != part.upper()))
        runs = [(low + m.start(), low + m.end()) for m in re.finditer("[0-9A-Za-z+/_-]+=*|=+", text[low:high])]
        taken = [(a, b) for a, b, _ in keys] + uuids
        spans = keys + [(*x, True) for a, b in runs for x in brute_windows(text, a, b, "+/_=-", taken)]
        wide = [widened(text, *next(r for r in runs if r[0] <= a < r[1]), a, b, across) for a, b, across in spans]
        rest = brute_windows(text, low, high, "=", wide + uuids) if len(runs) > 1 else []
        found += union(wide + [widened(text, low, high, *x, False) for x in rest])
    return found


def key_like(rng):
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abc-", "+/=_-", "ab0", "0123456789"]
    words = ["example/", "123e4567-e89b-12d3-a456-426614174000", "password=", "/some/long-path/of_words", "x1y2" * 6]
    piece = lambda: "".join(rng.choice(a) for _ in range(rng.randrange(45))) if (a := rng.choice(alphabets + words)) in alphabets else a
    return "".join(piece() + rng.choice(["", "-", "/", "=", "_", "+", " ", "=="]) for _ in range(rng.randrange(1, 7)))


def test_entropy_spans_match_brute_force():
    rng = random.Random(8)
    for _ in range(1500):
        text = key_like(rng)
        base = brute(text)
        want = [(a, b) for a, b in brute_entropy_spans(text) if not any(x <= a and b <= y for _, x, y in base)]
        assert [(a, b) for k, a, b in secret_spans(text) if k == "entropy"] == want, text


@pytest.mark.parametrize("kind", ["dashes", "keys", "parts", "equals", "words"])
def test_long_candidates_take_linear_time(kind):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_text = lambda n: "".join(rng.choices(letters, k=n))
    makers = {
        "dashes": lambda n: "-" * n + "1",
        "keys": lambda n: "".join(rng.choices(letters + "+/", k=n)),
        "parts": lambda n: "-".join(random_text(24) for _ in range(n // 25)),
        "equals": lambda n: "=".join(random_text(24) for _ in range(n // 25)),
        "words": lambda n: "/".join("some-path1" for _ in range(n // 11)),
    }
    text = makers[kind](1_000_000)
    began = time.process_time()
    secret_spans(text)
    assert time.process_time() - began < 4  # about a second; a quadratic scan takes minutes


def test_random_strings_are_found_and_plain_text_is_left():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    assert sum(any(k == "entropy" for k, *_ in secret_spans(f"see {key} there")) for key in keys) >= 195
    plain = "thentionerthinghanouthe internationalization https://host.example.com/en/some-long-path/of-words 123e4567-e89b-12d3-a456-426614174000 123456789012345678901 zzzzzzzzzzzzzzzzzzzzzzzzzzzz aVeryLongCamelCaseNameInCode"
    assert secret_spans(plain) == []
    assert redacted(f"a {keys[0]} b") == "a [SECRET] b"


PREFIXES = ("", "key=", "sig=", "id-", "k_", "/v1/keys/", "SIGNING_KEY=", "https://host.example.com/v2/some-path/of_words?sig=", "example/", "user_id=123e4567-e89b-12d3-a456-426614174000/")


def covered(text, start, end):
    held = set()
    for _, a, b in secret_spans(text):
        held.update(range(a, b))
    return held.issuperset(range(start, end))


def test_keys_behind_prefixes_are_covered_as_a_whole():
    rng = random.Random(6)
    kinds = {
        "upper hex": ("0123456789ABCDEF", 32, 0.99),
        "lower hex": ("0123456789abcdef", 32, 1.0),
        "short lower hex": ("0123456789abcdef", 22, 0.97),
        "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 0.97),
        "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 32, 0.97),
        "letters and digits": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 32, 0.97),
        "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 43, 0.97),
    }
    for kind, (alphabet, length, share) in kinds.items():
        for prefix in PREFIXES:
            if kind == "base64" and prefix == "example/":
                continue  # a run with separators that names itself a sample is on the allow-list
            found = 0
            for _ in range(300):
                key = "".join(rng.choice(alphabet) for _ in range(length)) + "=" * (kind == "base64")
                found += covered(f"see {prefix}{key} there", 4 + len(prefix), 4 + len(prefix) + len(key))
            assert found >= share * 300, (kind, prefix, found)


def test_parts_that_are_no_keys_are_left():
    key = "9F86D081884C7D659A2FEAA0C55AD015"
    assert [redacted(f"a {x}{key} b") for x in ("key=", "id-", "k_", "/v1/keys/")] == [f"a {x}[SECRET] b" for x in ("key=", "id-", "k_", "/v1/keys/")]
    assert redacted(f"{key}-{key[::-1]}/end") == "[SECRET]-[SECRET]/end"
    plain = "user_id=123e4567-e89b-12d3-a456-426614174000/ /v2/items/12345678901234567890123 q=/some/long-path/of_words /v1/internationalizationofeverything"
    assert secret_spans(plain) == []


def test_rows(spark):
    rows = [(1, "token=abcdef1", "s"), (2, None, "s"), (3, "", "s"), (3, "", "s"), (None, "é AKIA" + "A1" * 8, "s"), (5, "x" * 200_000 + " " + "ab" * 12, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in scan_secrets(docs).collect()}
    want = set()
    for i, text, _ in rows:
        base = brute(text or "")
        want.add((i, joined(base), hashlib.sha256(joined(base).encode()).hexdigest(), *[sum(x[0] == k for x in base) for k in BASE]))
    assert got == want
    assert scan_secrets(docs).count() == 6 and scan_secrets(docs.limit(0)).count() == 0
    assert docs.select(redact("text").alias("t")).filter("t is null").count() == 1
