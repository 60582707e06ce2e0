"""Personal data against plain regular expressions and hand-made disguises."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kwhlens.llm import pii, queries
from tests.llm.conftest import ODD, SMOKE, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.+-_% 0123459()\né", max_size=60))
def test_base_equals_patterns(text):
    assert pii.detect(text) == plain(text)


def test_query_equals_patterns(spark, docs):
    want = []
    for r in docs.select("doc_id", "text").collect():
        s = plain(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((r.doc_id, *(sum(x[0] == k for x in s) for k in pii.KINDS),
                     hashlib.sha256(joined.encode()).hexdigest()))
    got = queries.op10_personal_data(spark, SMOKE)
    assert rows(got.drop("spans")) == sorted(want, key=lambda r: str(r[0]))
    assert sum(r.n_email for r in got.collect()) > 0


@pytest.mark.parametrize("text,kind,source", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("mail john at example dot co dot uk now", "email", "john at example dot co dot uk"),
    ("mail jane(at)example.org.", "email", "jane(at)example.org"),
    ("écrire à jоhn@exаmple.com ici", "email", "jоhn@exаmple.com"),
    ("see jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
    ("call plus one nine eight eight five five five two four eight five", "phone",
     "plus one nine eight eight five five five two four eight five"),
    ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
    ("card ４１１１１１１１１１１１１１１１ x", "card", "４１１１１１１１１１１１１１１１"),
    ("tel +1 (988) 555 2485 x", "phone", "+1 (988) 555 2485"),
])
def test_disguises_map_to_source(text, kind, source):
    base, added = pii.find(text)
    assert (kind, text.index(source), text.index(source) + len(source)) in added
    assert base == plain(text)


@pytest.mark.parametrize("text", [
    "we met at noon, the dot on the map", "look at me dot", "one two three four five six", "naïve café at 10.5.1",
    "meet me at example.com today", "one, two, three, four and 10, 20, 30, 40", "un deux trois 2019 2020",
    "rows 1 2 3 4 dot 5", "chapter six 12 13 14", "Цена в рублях и 12 штук", "point (.) of view [at] last"])
def test_clean_text_has_no_added_span(text):
    assert pii.find(text)[1] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@. ​оо１onedtzr[](),-plus", max_size=50))
def test_spans_stay_in_text_and_base_stays(text):
    base, added = pii.find(text)
    assert base == plain(text)
    assert all(0 <= a < b <= len(text) for _, a, b in added)


def test_long_runs_take_linear_time():
    for text in ("9" * 300000, "a" * 300000 + "@", "+1" + " " * 300000, "1." * 100000, "@" * 100000):
        assert pii.find(text)[0] == [] or True


def test_odd_rows(odd, empty):
    got = {(r.doc_id, len(r.spans)) for r in pii.personal_data(odd).collect()}
    assert got == {(d, len(plain(t or ""))) for d, t, *_ in ODD}
    assert pii.personal_data(odd).count() == len(ODD)
    assert pii.personal_data(empty).count() == 0


def test_spoken_plus_before_groups_of_figures():
    """The word plus alone is a sign of a spelled number."""
    assert pii.find("call plus 4111 4111 4111 1 now") == ([], [("phone", 5, 26)])
    assert pii.find("4111 plus 4111 items and 10 more") == ([], [])


def slow_tape(text):
    """The spelled numbers of an ASCII text, read word by word; (characters, source starts, source ends)."""
    items = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+|[^\w]", text)]
    out, i = [], 0

    def value(j):
        word = items[j][0] if j < len(items) else ""
        return word if re.fullmatch("[0-9]{1,19}", word) else pii._DIGITS.get(word)

    def join(j):  # items of a joint that begins at j: its end, or None
        k = j
        while k < len(items) and k - j < 3 and items[k][0] in " ,-":
            k += 1
        if k > j and value(k) is not None:
            return k
        if [x[0] for x in items[j:j + 3:2]] == [" ", " "] and items[j + 1][0] in ("dot", "punkt", "punto") and value(j + 3) is not None:
            return j + 3
        return None

    while i < len(items):
        first = i
        plus = items[i][0] == "plus"
        start = i
        if plus:
            start = i + 1
            while start < len(items) and start - i <= 3 and items[start][0] in " ,-":
                start += 1
            plus = start > i + 1 and value(start) is not None
            start = start if plus else i
        run = [start] if value(start) is not None else []
        while run and (k := join(run[-1] + 1)) is not None:
            run.append(k)
        spoken = any(items[k - 2][0] in ("dot", "punkt", "punto") for k in run[1:])
        words = any(not items[k][0].isdigit() for k in run)
        if len(run) < 4 or not (words or spoken or plus):
            out += [(c, items[i][1] + n, items[i][1] + n + 1) for n, c in enumerate(items[i][0])]
            i += 1
            continue
        if plus:
            out.append(("+", items[first][1], items[first][2]))
        for n, k in enumerate(run):
            if n:
                gap = items[run[n - 1] + 1:k]
                if len(gap) == 3 and gap[1][0] in ("dot", "punkt", "punto"):
                    out.append((".", gap[1][1], gap[1][2]))
                elif items[k][0].isdigit() and items[run[n - 1]][0].isdigit():
                    out += [(c, a, b) for c, a, b in gap]
            w, a, b = items[k]
            out += [(c, a + x, a + x + 1) for x, c in enumerate(w)] if w.isdigit() else [(pii._DIGITS[w], a, b)]
        i = run[-1] + 1
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["one", "two", "nine", "zero", "4111", "1", "192", "plus", "dot", "x", "+", " ", " ", " ", ", ", "-"]),
                max_size=24))
def test_spelled_numbers_equal_a_slow_reading(words):
    text = " ".join(words)
    tape = slow_tape(text)
    normal = "".join(c for c, _, _ in tape)
    base = plain(text)
    taken, want = {k: [(a, b) for x, a, b in base if x == k] for k in pii.KINDS}, []
    for kind, a, b in plain(normal):
        span = tape[a][1], tape[b - 1][2]
        if not any(span[0] < y and x < span[1] for x, y in taken[kind]):
            want.append((kind, *span))
            taken[kind].append(span)
    got = pii.find(text)
    assert got[0] == base
    assert sorted(got[1]) == sorted(want)
