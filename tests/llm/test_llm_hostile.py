"""Long and broken texts take time in proportion to their length, and what earlier cut-offs lost is found."""

import time

import numpy as np
import pytest
from test_llm_operators import SF, docs  # noqa: F401

from labelproof.llm import decontaminate, html_main, pii, token_files, toxicity
from labelproof.llm import sentencepiece_viterbi as viterbi
from labelproof.llm.common import Memo, ship

N = 400_000
PAGES = {
    "quotes": '<a "' * (N // 4), "quotes and an end": '<a "' * (N // 4 + 1) + '">', "tags without end": "<a " * (N // 3), "mixed quotes": '<a "x\' ' * (N // 7) + ">",
    "nested": "<div>" * (N // 11) + "deep text, here." + "</div>" * (N // 11), "unmatched": "<div>" * (N // 11) + "</span></p>" * (N // 11), "declarations": "<!" * (N // 2),
    "lists": "<ul><li>x" * (N // 9), "comments": "<!--" * (N // 4), "paragraphs": "<p>" * (N // 3),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_broken_markup(name):
    start = time.time()
    text = html_main.main_text(PAGES[name])
    assert time.time() - start < 20
    assert name != "nested" or text == "deep text, here."


@pytest.mark.parametrize("word", ["-" * N, "a" + "-" * N + "b", "." * N, "a." * (N // 2), "\"'" * (N // 2)])
def test_words_of_punctuation(word):
    field = pii.train(["mail a.b@c.example.org or call +1 415 555 2671"] * 3)
    start = time.time()
    pii.all_spans(word + " 12 at", field)
    toxicity.plain(word)
    assert time.time() - start < 10


def test_pages_without_an_article():
    assert html_main.main_text("<body><div>Lead part, with text. And more.</div><div>Second part here, also long. Yes.</div></body>") == (
        "Lead part, with text. And more. Second part here, also long. Yes.")
    menu = "<ul><li><a href=/>Home</a><li><a href=/about>About us</a></ul>"
    assert html_main.main_text(f"<body>{menu}<div><p>Real text, with words. And more.</p><p>Short</p></div></body>") == "Real text, with words. And more. Short"


def test_several_articles_and_text_between_them():
    page = """<main><p>Intro, some text. ok.</p><article><p>One text, long enough. yes.</p></article><article><p>Two short.</p><ul><li><a href=x>Link one</a>
      <li><a>Link two</a></ul><p class=legal>Legal words.</p><div class="share">Share</div></article><article class="comment"><p>Me too, thanks. Really.</p></article></main>"""
    assert html_main.main_text(page) == "Intro, some text. ok. One text, long enough. yes. Two short. Link one Link two Legal words."
    assert html_main.main_text("<article><p>First one, good. Yes.</p></article><div><p>x</p></div><article><p>B.</p></article>") == "First one, good. Yes. B."


def test_page_tables(spark):
    pages = ship(spark).createDataFrame([(1, "<p>a, b.</p>", "x"), (1, "<p>a, b.</p>", "x"), (2, None, "y"), (3, "", "z")], "page_id long, html string, text_ string")
    rows = html_main.main_texts(pages.select("page_id", "text_", "html"))
    assert sorted((r["page_id"], r["text"], r["text_"]) for r in rows.collect()) == [(1, "a, b.", "x"), (1, "a, b.", "x"), (2, "", "y"), (3, "", "z")]
    assert html_main.main_texts(pages.select("page_id", "text_", "html").limit(0)).count() == 0


def test_addresses_in_words(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[0-9@]'").collect()]
    field = pii.train(texts)
    for spelled in ["jane at example dot com", "jane [at] example [dot] com", "jane(at)example.com", "x at mail dot example dot org", "jo.doe@example dot com"]:
        text = f"please write to {spelled} today, or come at noon"
        assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, field)[1]] == [(0, spelled)], spelled
    for clean in ["meet me at noon dot", "we look at the dot com bubble", "see it at page 12 dot"]:
        assert not pii.all_spans(clean, field)[1], clean


def test_spelled_training_lines_are_candidates():
    field = pii.Field()
    for kind, spelled in pii.spellings(0, "jane.doe@mail.example.org"):
        chunks = next(pii.stretches(f"to {spelled} now"), None)
        if kind == 0:
            assert any((a, b) == (3, 3 + len(spelled)) for _, _, a, b, _ in field.segments(f"to {spelled} now", chunks)), spelled


def test_item_ids_are_texts(spark):
    words = "one two three four five six seven eight nine ten"
    data = ship(spark).createDataFrame([(1, f"see {words} there"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([("mmlu-7", words), (None, words), ("x", None)], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.leak_report(data, items).collect()}
    assert got[1]["n_items"] == 1 and got[1]["contaminated"] and not got[2]["contaminated"]


def test_indented_code_takes_pieces_of_spaces():
    encoder = viterbi.encoder_of(viterbi.vocabulary())
    ids = np.frombuffer(encoder.encode(["        return x"])[0], "<i4").tolist()
    by_id = {k: p for p, k in encoder.pieces.ids.items()}
    assert len(ids) == 3 and set(by_id[ids[0]]) == {"▁"} and encoder.decode(np.array(ids, "<i4").tobytes()) == "        return x"

    def best(text):
        score = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - encoder.pieces.width), j):
                s = encoder.pieces.scores.get(text[i:j], encoder.pieces.unknown if j - i == 1 else None)
                if s is not None:
                    score[j] = max(score[j], score[i] + s)
        return score[-1]

    for text in ["if x:\n        return  y", "   a    b" * 5, " " * 40, "x" + " " * 33, "\t    z"]:
        got = [by_id[k] for k in np.frombuffer(encoder.encode([text])[0], "<i4").tolist() if k in by_id]
        whole = "▁" + text.replace(" ", "▁")
        missing = sum(c not in encoder.pieces.ids for c in whole)
        assert abs(sum(encoder.pieces.scores[p] for p in got) + missing * encoder.pieces.unknown - best(whole)) < 1e-6
        assert encoder.decode(encoder.encode([text])[0]) == text


def test_kept_values_are_bounded():
    learned = []
    memo = Memo(lambda pieces: learned.extend(pieces) or [p * 2 for p in pieces], 10)
    for k in range(0, 60, 3):
        assert memo.values([1, 2, k + 100, k + 101, k + 102]) == [2, 4, 2 * k + 200, 2 * k + 202, 2 * k + 204]
        assert len(memo.young) + len(memo.old) <= 20
    assert learned.count(1) == 1 and memo.getter({1, 7})(7) == 14


def test_token_ids_of_odd_pieces():
    from tokenizers import Tokenizer
    import pyarrow as pa
    import random

    tokenizer, encoder, rng = Tokenizer.from_file(token_files.vocabulary()), token_files.encoder_of(token_files.vocabulary()), random.Random(9)
    parts = [*"abc DEF  \n\t\r\x0b\x0c.,!?'é日́\xa0 1234", "'s", "<|endoftext|>", "</w>", encoder.mark, "À", "×", "²", "xyz,", "9a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(2_000)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)).to_pylist(), strict=True):
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, token_files.END_ID]
