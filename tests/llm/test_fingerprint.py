import random

from helpers import DOCS, odd_rows, sha256, words
from vecflow.llm import fingerprint as fp


def lz_phrases(text):
    """Plain Lempel-Ziv parse: the shortest prefix of the rest that is not known yet."""
    seen, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while text[i:j] in seen and j < len(text):
            j += 1
        seen.add(text[i:j])
        out.append(text[i:j])
        i = j
    return out


def test_parse_is_the_plain_parse():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 500):
        for alphabet in ("a", "ab", "abcdé漢"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            found = []
            ends = fp.parse(text, 0, set(), found)
            assert found == lz_phrases(text) and ends == [sum(map(len, found[:k + 1])) for k in range(len(found))]


def test_shared_parse_equals_two_parses():
    rng = random.Random(2)
    for _ in range(200):
        text, after = (words(rng, rng.randrange(0, 60), 9) for _ in range(2))
        edited = fp.edited_text(text, after)
        a, b = fp.both_fingerprints(text, edited, len(text) - len(text) // 4)
        assert (a == fp.fingerprint(text)).all() and list(b) == list(fp.fingerprint(edited))


def test_likeness():
    rng = random.Random(3)
    a, b = fp.fingerprint(words(rng, 400)), fp.fingerprint("".join(rng.choice("qrstuvxyz") for _ in range(900)))
    none = fp.fingerprint(None)
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.1 and fp.likeness(none, none) == 1 and fp.likeness(a, none) == 0
    assert list(fp.from_text_form(fp.text_form(a))) == list(a)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for r, after in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", after[1] or ""
        e = fp.edited_text(t, u)
        out.append((r[0], len(t), sha256(e.encode()), fp.text_form(fp.fingerprint(t)), fp.text_form(fp.fingerprint(e)),
                    fp.likeness(fp.fingerprint(t), fp.fingerprint(e)), fp.likeness(fp.fingerprint(t), fp.fingerprint(u))))
    return out


def test_odd_rows(spark):
    rows = odd_rows()
    got = [tuple(r) for r in fp.edit_fingerprints(spark.createDataFrame(rows, DOCS).repartition(4)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_one_row_and_none(spark):
    got = fp.edit_fingerprints(spark.createDataFrame([(4, "abcdefgh", "", 1, 1)], DOCS)).collect()
    assert [(r.doc_id, r.near_next) for r in got] == [(4, 1.0)] and got[0].edited_sha256 == sha256(b"abcdefab")
    assert fp.edit_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
