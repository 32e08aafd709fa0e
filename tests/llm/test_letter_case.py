"""Decontamination of copies in other letter case, with number words and names of every form.

Which copies are copies is stated here, not worked out by the operator's own classes.
"""

import random

import pytest

from chronoloom.llm import decontaminate

ITEM = "If {a} has {x} red apples in the basket and {b} brings {y} more from the market, how many apples do {a} and {b} share at the end of the day in the old house by the river"
FILLER = "the weather was mild and people walked along the shore while music came from somewhere behind the trees and nobody seemed to be in any hurry".split()


def told(a, b, x, y):
    return ITEM.format(a=a, b=b, x=x, y=y)


def within(text, seed):
    """The text between unrelated sentences."""
    rng = random.Random(seed)
    some = lambda: " ".join(rng.choices(FILLER, k=60))
    return f"{some()}. {text}. {some()}"


COPIES = {
    "verbatim": told("Tom", "Mary", 3, 5),
    "small letters": told("Tom", "Mary", 3, 5).lower(),
    "capitals": told("Tom", "Mary", 3, 5).upper(),
    "small letters, other numbers": told("Tom", "Mary", 8, 11).lower(),
    "capitals, other numbers": told("Tom", "Mary", 8, 11).upper(),
    "other names": told("Anna", "Olga", 3, 5),
    "capital names": told("PETER", "JOHN", 3, 5),
    "inner capitals": told("McGregor", "O'Brien", 4, 6),
    "number words": told("Tom", "Mary", "nine", "twenty-one"),
    "all others": told("DeShawn", "LeBron", "seven", "forty"),
}
OTHERS = {
    "another question": "If Tom has 3 green pears on the table and Mary takes 5 away to her school, what number of pears will Tom have left when the week is over in the new flat near the station",
    "nothing": "",
}


@pytest.mark.parametrize("item", [told("Tom", "Mary", 3, 5), told("JOHN", "McDonald", "three", "twelve"), told("tom", "mary", "three", "five")])
def test_copies_in_any_case_are_found_and_others_are_not(spark, item):
    texts = list(COPIES.values()) + list(OTHERS.values())
    docs = spark.createDataFrame([(k, within(t, k)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"] for r in decontaminate.contaminated_pairs(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    # an item in small letters shows no names, so it is met by its own names only
    same = {"verbatim", "small letters", "capitals", "small letters, other numbers", "capitals, other numbers", "number words"}
    want = set(COPIES) if item.startswith("If Tom") else same if item.startswith("If tom") else {"verbatim", "other names", "capital names", "inner capitals", "number words", "all others"}
    assert {k for k in want if list(COPIES).index(k) not in found} == set()
    assert not found & set(range(len(COPIES), len(texts)))


def test_short_items_in_any_case(spark):
    items = spark.createDataFrame([(0, "Who wrote Hamlet"), (1, "Twelve monkeys")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "some line\nwho wrote hamlet?\nmore"), (1, "WHO WROTE HAMLET"), (2, "Who wrote novels about it"), (3, "twelve monkeys")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert {(0, 0), (1, 0), (3, 1)} <= found and not {d for d, _ in found} & {2}


def test_hashes_of_words_are_bounded_in_bytes(monkeypatch):
    from chronoloom.llm import toxicity

    monkeypatch.setattr(toxicity, "_MEMO_BYTES", 2000)
    fresh, kept = toxicity.Featurizer(), toxicity.Featurizer()
    texts = [" ".join(f"w{i}x{k}" for i in range(20)) + " " + "z" * 500 for k in range(30)]
    for t in texts:
        assert (kept.words(t) == toxicity.Featurizer().words(t)).all()
        assert kept._hash.used <= 2000 + 21 * 250 and all(len(w) <= toxicity._MEMO_PIECE for w in kept._hash)
    assert (fresh.places("a b c") == kept.places("a b c")).all()
