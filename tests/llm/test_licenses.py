"""Templates against a plain recursive matcher, and texts that hold nothing."""

import random

import pytest

from sunmeter.llm import licenses
from sunmeter.llm.licenses import Automaton, Template, base_phrase, parse, words_of

MIXED = (
    Template("t1", "x", "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>> f"),
    Template("t2", "y", 'b <<var;name="n";original="o";words="0-2">> f'),
    Template("t3", "z", 'a <<var;name="n";original="o";words="1-3">>'),
    base_phrase("a b", "base"),
)


def ends(parts, words, at):
    """All places where ``parts``, begun at ``at``, may end."""
    if not parts:
        return {at}
    kind, rest = parts[0][0], parts[1:]
    if kind == "word":
        return ends(rest, words, at + 1) if words[at:at + 1] == [parts[0][1]] else set()
    if kind == "optional":
        return ends(rest, words, at) | ends(parts[0][1] + rest, words, at)
    return {end for n in range(parts[0][1], parts[0][2] + 1) if at + n <= len(words)
            for end in ends(rest, words, at + n)}


def test_random_texts_match_as_a_plain_matcher_says():
    automaton, rnd = Automaton(MIXED), random.Random(1)
    for _ in range(2000):
        words = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 14))]
        want = [(t, at, max(found)) for at in range(len(words)) for t, template in enumerate(MIXED)
                if (found := ends(parse(template), words, at))]
        assert automaton.find(words) == want


def test_few_cached_states_change_nothing(monkeypatch):
    monkeypatch.setattr(licenses, "MAX_CACHED_STATES", 2)
    words = list("abcdefabfab")
    assert Automaton(MIXED).find(words) == Automaton(MIXED).find(words) != []


@pytest.mark.parametrize("text", [
    "", "<<beginOptional>>a<<endOptional>> b", '<<var;name="x";words="1-2">> b', "a <<what>>",
    "a <<beginOptional>> b", 'a <<var;name="x";words="3-1">>'])
def test_bad_templates(text):
    with pytest.raises(ValueError):
        parse(Template("t", "t", text))


def test_a_whole_license_with_a_holder_of_its_own():
    template = next(t for t in licenses.LICENSE_TEMPLATES if t.name == "mit-text")
    text = licenses._MARK.sub(lambda m: "Jane Doe" if m[1].startswith("var") else " ", template.text)
    automaton = Automaton((template,))
    assert automaton.find(words_of("Copyright.\n\n" + text + " and more"))
    assert not automaton.find(words_of(text.replace("MERCHANTABILITY", "merchandise")))


def test_scan(spark):
    rows = [(1, "Released UNDER the MIT-License!"), (2, "under the mit license " * 3), (3, None),
            (4, ""), (4, ""), (None, "cc by-nc 4.0"), (5, "word " * 200_000 + "apache license, version 2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as n_words", "'x' as matches")
    got = {(r["doc_id"], r["n_words"]): [(m["template"], m["first"], m["last"]) for m in r["matches"]]
           for r in licenses.scan(docs).collect()}
    assert got == {
        (1, 5): [("mit-notice", 0, 4), ("base:mit", 1, 4)],
        (2, 12): [("base:mit", 0, 3), ("base:mit", 4, 7), ("base:mit", 8, 11)],
        (3, 0): [], (4, 0): [], (None, 5): [("base:cc-by-nc", 0, 2)],
        (5, 200_004): [("base:apache-2", 200_000, 200_003)]}
    assert licenses.scan(docs).count() == 7
    assert licenses.scan(docs.limit(0)).count() == 0


def test_words_are_of_letters_digits_and_all_beyond_ascii():
    assert words_of("ÉA-b_c1\tD² x") == ["Éa", "b", "c1", "d² x"]
