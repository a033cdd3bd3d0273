import re

from neo.llm import license_scan as L
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in L.BASE.items() for p in [phrase.split()]
                    for i in range(len(words)) if words[i:i + len(p)] == p)
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


TEXTS = ["MIT License. Under the mit-license; Apache\n\nLicense", "the GNU General Public\tLicense v3", "mitlicense mit licence",
         "summit license mit licenses", "Permision is herby granted, free of charge", "Émit license", "mit " * 50 + "license",
         "All rihts reserved", "x" * 5000 + " apache license"]


def test_base_and_notices(spark):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (not r.n_base or r.score == 1)
    assert {s.label: s.edits for s in got[2].spans} == {"mit": 1}  # two places, one edit each
    assert "mit" in got[4].labels and 0 < got[4].score < 1
    assert "reserved" in got[7].labels
    assert got[6].n_base == 1 and got[6].first_word == 49


def test_seeds_cover_every_edit():
    for pattern in L.NOTICES:
        k = L.allowed_edits(pattern)
        parts = L.pieces(pattern, k)
        assert len(parts) == k + 1 and b"".join(p for _, p in parts).decode() == pattern
        assert all(pattern.encode()[a:].startswith(p) for a, p in parts)


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(odd).collect()),
                 key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in odd_rows()), key=str)
    assert L.scan(none).count() == 0
