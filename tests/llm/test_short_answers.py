"""Questions and answers that a document holds while the item as a whole is edited."""

from ledgerkit.llm import decontaminate
from ledgerkit.llm.decontaminate import Index, question_and_answer

Q = "what is the colour of the old house by the river that my uncle built"


def test_short_answers_within_longer_passages():
    index = Index([(1, f"{Q}\ndark green")])
    assert list(index.leaks(f"some noise {Q} and it was then DARK green as all know")) == [0]
    assert list(index.leaks(f"some noise {Q} and it was then dark as a green bottle")) == [0]  # the item itself: 11 of its 12 shingles are the question's
    index = Index([(1, "who built this old house\nmy uncle")])
    assert list(index.leaks("tell us who built this old house for it was my uncle who had the money")) == [0]
    assert not index.leaks("tell us who built this old house for it was my old uncle who had the money")
    short = Index([(1, "who then\nthe uncle of this family had the money for all of it")])
    assert list(short.leaks("the uncle of this family had the money for all of it said he and who then would")) == [0]
    assert not short.leaks("the uncle of this family had nothing and who then would")


def test_full_stops_stay_with_their_words():
    assert question_and_answer("One two three. Four five.") == ([b"one", b"two", b"three."], [b"four", b"five."])
    assert question_and_answer("One two three.") == ([], [b"one", b"two", b"three."])
    index = Index([(1, "who built this old house. it was my uncle.")])
    (held,) = index.leaks("well, who built this old house. we know it was my uncle. that is all").values()
    assert held[2:] == (1.0, 1.0)


def test_answer_far_from_its_question(spark):
    a = "the old house is green with a white door and two windows"
    items = spark.createDataFrame([(1, f"{Q}\n{a}")], "item_id long, text string")
    far = f"{Q}{' noise' * 900} {a}"
    docs = spark.createDataFrame([(1, far), (2, f"{a}{' noise' * 900} {Q}"), (3, Q), (4, a)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, items).collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(docs, items).collect()) == [3, 4]
