import itertools
import math
import random
import time

from parcelflow.llm import secrets as S


def brute(s: str) -> float:
    """Every segmentation; neighbouring brute-force spans cost as two."""
    if not s:
        return 0.0
    segs = {}
    patterns = S.Patterns(s, S.dictionary())
    for i in range(len(s)):
        for j, _, c in patterns.at(i):
            segs[i, j] = min(c, segs.get((i, j), math.inf))
        for j in range(i + 1, len(s) + 1):
            segs[i, j] = min(segs.get((i, j), math.inf), sum(map(S.per_char, s[i:j])))
    best = math.inf
    for cuts in itertools.product((0, 1), repeat=max(0, len(s) - 1)):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(s)]
        best = min(best, sum(segs[a, b] for a, b in zip(at, at[1:])) + S.SWITCH * (len(at) - 2))
    return max(0.0, best)


def test_cheapest_segmentation():
    r = random.Random(3)
    cases = ["password", "P4ssw0rd1", "qwerty12", "aaaaabbb", "19991231", "xk3password", "letmein99", "abcabcabc", "zaq1zaq1", ""]
    cases += ["".join(r.choice("abq1w2e3ps0") for _ in range(r.randrange(1, 11))) for _ in range(30)]
    for s in cases:
        cost, segs = S.guess_cost(s)
        assert abs(cost - brute(s)) < 1e-9, s
        assert [a for a, _, _ in segs] == [0, *(b for _, b, _ in segs)][: len(segs)] and (not segs or segs[-1][1] == len(s))


def every_span(s: str) -> set:
    """Repeats and walks by definition."""
    out = set()
    for i in range(len(s)):
        for unit in (1, 2, 3, 4):
            for m in range(3 if unit == 1 else 2, (len(s) - i) // unit + 1):
                if s[i : i + m * unit] == s[i : i + unit] * m:
                    out.add((i, i + m * unit, "repeat", round(sum(map(S.per_char, s[i : i + unit])) + math.log10(m), 9)))
        for j in range(i + 4, len(s) + 1):
            steps = [S._step(a, b) for a, b in zip(s[i:j].lower(), s[i + 1 : j].lower())]
            if None not in steps:
                out.add((i, j, "walk", round(S.START + math.log10(j - i) + math.log10(8) * (1 + sum(a != b for a, b in zip(steps, steps[1:]))), 9)))
    return out


def test_repeats_and_walks_by_definition():
    r = random.Random(8)
    cases = ["aaaaaaa", "abababab", "qwertyuiop", "qwqwqwqw", "zaq12wsx", "AAbbAAbb", "1234567890-="] + ["".join(r.choice("qwea1") for _ in range(r.randrange(1, 13))) for _ in range(60)]
    for s in cases:
        p = S.Patterns(s, S.Dictionary([]))
        assert {(i, j, k, round(c, 9)) for i in range(len(s)) for j, k, c in p.at(i) if k in ("repeat", "walk")} == every_span(s), s  # short enough for all of them


def test_patterns_are_cheap_and_random_values_dear():
    for s in ("password", "changeme", "qwertyuiop", "aaaaaaaaaaaaaaaa", "2024-01-31", "your-token-here"[5:10], "P@ssword", "aaaaaaaaaaaapple", "A" * 5000):
        assert S.guess_cost(s)[0] < S.MIN_COST, s
    for s in ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "wJalrXUtnFEMI/K7MDENG/bPxRfiCY", "x9Q!v2Lp0zR#"):
        assert S.guess_cost(s)[0] >= S.MIN_COST, s


PROSE = (
    "Token: authentication is required. Secret = something nobody told. The password: optional for guests. Access_key: disabled by default. Token: documentation, see below. Credential: management of all accounts. "
    "secret: ingredient\npassword: required\ntoken = invalid\npassphrase: forgotten\nsecret: tomorrow\npwd: directory\ntoken: expired\nauthorization: pending\nbearer: unknown\nsecret: Wednesday\npassword: incorrect"
)


def test_clean_prose_has_no_secrets():
    found = [(v, S.guess_cost(v)[0]) for _, v, *_ in S.find(PROSE)]
    assert len(found) == 17 and all(c < S.MIN_COST for _, c in found), found


def test_time_is_linear():
    def took(s: str) -> float:
        start = time.perf_counter()
        S.guess_cost(s)
        return time.perf_counter() - start

    for unit in ("A", "z8Kq", "qw", "1q2w3e"):
        assert min(took(unit * (16_000 // len(unit))) for _ in range(2)) < 6 * min(took(unit * (4_000 // len(unit))) for _ in range(2)) + 0.02, unit
    for text in ("a" * 200_000 + "=", "password" + " " * 200_000 + "= x", "x: " * 60_000, 'token = "' * 20_000, "token=" * 30_000, "secret: ,,,," * 10_000, 'secret: \\"a' * 10_000):
        start = time.perf_counter()
        list(S.find(text))
        assert time.perf_counter() - start < 2, text[:20]


def test_names_and_values_of_any_length():
    key = "".join(random.Random(4).choices("abcdef0123456789", k=5000))
    assert [(k, v) for k, v, *_ in S.find(f'password{" " * 450}= "{key}"')] == [("password", key)]
    assert [(k, v) for k, v, *_ in S.find(f"{'my_' * 300}token = {key}")] == [("my_" * 300 + "token", key)]


def test_context():
    t = 'x token = "abc123def456" y, API-KEY: zzzz9999 http://a.b/c password="" my_password => \'pq rs\' TOKEN=ABCD "client_secret": "v1v1v1"'
    assert [(k, v) for k, v, *_ in S.find(t)] == [("token", "abc123def456"), ("API-KEY", "zzzz9999"), ("my_password", "pq rs"), ("TOKEN", "ABCD"), ("client_secret", "v1v1v1")]
    assert all(t[a:b] == v for _, v, a, b in S.find(t))
    assert not list(S.find("a tokenised = b: c\nsecretary"[:9])) and not list(S.find("x = 1; y: 2"))
    for t, want in (
        (r'{\"password\": \"s3cr,et\"}', "s3cr,et"), ('token = "open to the end\nnext', "open to the end"), ("token=ab,cd;ef|gh next", "ab,cd;ef|gh"), ("token=abcd1,user=bob", "abcd1"), ("DB_PASS: x9x9x9,", "x9x9x9"),
        ("Authorization: Bearer abcdef", "abcdef"), ("signing_key=q1q1q1", "q1q1q1"),
    ):
        assert [v for _, v, *_ in S.find(t)] == [want], t


def test_scan_and_mask(spark, odd, empty):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = [(1, f'né token = "{secret}" end', 10), (1, f'né token = "{secret}" end', 10), (None, f"pwd: {secret}", 1), (2, "password = changeme", 1), (3, None, 1), (4, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = S.scan(df).collect()
    assert sorted(((r["doc_id"] or 0, r["value"], r["secret"]) for r in got)) == sorted([(1, secret, True), (1, secret, True), (0, secret, True), (2, "changeme", False)])
    out = S.mask(df).collect()
    assert len(out) == len(rows) and not any(secret in (r["text"] or "") for r in out)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] and S.MASK in r["text"])
    assert [r["text"] for r in out if r["doc_id"] == 2] == ["password = changeme"]
    assert S.scan(odd).count() == 0 and sorted(map(str, S.mask(odd).collect())) == sorted(map(str, odd.collect()))
    assert S.scan(empty).count() == 0 and S.mask(empty).count() == 0
