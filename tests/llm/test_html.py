"""Main text: odd and hostile pages, and the decoder against all state sequences."""

import itertools
import random
import time

import pytest

from screenspark.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.train()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("plain text without markup that goes on for a while.", "plain text without markup that goes on for a while."),
        ("<div><div><div>This is the first full article sentence.</div><div>And another one follows it here.</div></div></div>", "This is the first full article sentence.\n\nAnd another one follows it here."),
        ("<div id='inhalt'><p>Dies ist der Artikel, und er hat Worte.</p></div>", "Dies ist der Artikel, und er hat Worte."),
        ('<p class="x>Hello you, reader of this.</p><p>World is here, with words.</p>', "Hello you, reader of this.\n\nWorld is here, with words."),
        ("<article><p>One is a sentence.</p><svg><p>Two is a sentence.</p></article>", "One is a sentence.\n\nTwo is a sentence."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be &amp; stay one.</p><script>no()</script></article>", "Let x=1 be & stay one."),
        ("<article><p>Before <script>if (a < b) x()</script>and after.</p><style>p{}</style></article>", "Before and after."),
        ("", ""),
        ("<div><math><p>The sun rose at dawn.</p><p>Second is a sentence.</p></div>", "The sun rose at dawn.\n\nSecond is a sentence."),
        ("<article><p>Let <math><mi>x</mi></p><p>Two is a sentence of its own.</p></article>", "Let x\n\nTwo is a sentence of its own."),
        ("<article><p>One is a sentence.</p><svg><svg></svg><text>lbl</text></svg></article>", "One is a sentence."),
        ("<article><p>One is a sentence.</p><object><object></object>x</object><canvas/><p>Two is a sentence.</p></article>", "One is a sentence.\n\nTwo is a sentence."),
        ('<div class="cookieBanner"><p>We use cookies on this page.</p></div><article><p>One is a sentence.</p></article>', "One is a sentence."),
        ('<article><p>One is a sentence.</p></article><div class="c-siteFooter__inner"><p>Some words of the house.</p></div>', "One is a sentence."),
        ("<article><p>One is a sentence, and more.</p><button>Share this</button><p>Two is another one.</p></article>", "One is a sentence, and more.\n\nTwo is another one."),
    ],
)
def test_pages_without_known_names_and_with_broken_markup(model, page, text):
    assert html_text.main_text(page, model)[0] == text


@pytest.mark.parametrize("unit", ["<a", "a < b <c ", '"<a" x', "</svg", "<svg>", "<p a='x", "<b>x<hr>", "<li><table>", "<!-- ", "<svg><svg></svg>", "<math><p>"])
def test_time_grows_with_length_only(model, unit):
    times = []
    for size in (200_000, 800_000):
        start = time.process_time()
        html_text.blocks(unit * (size // len(unit)), model.known)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 0.5


def test_viterbi_is_the_best_of_all_sequences(model):
    rng = random.Random(3)
    names = sorted(model.scores)
    for _ in range(40):
        rows = [rng.sample(names, 4) for _ in range(rng.randint(1, 7))]

        def worth(states, rows=rows):
            total, before = 0.0, 2
            for row, state in zip(rows, states):
                total += model.steps[before][state] + sum(model.scores[f][state] for f in row)
                before = state
            return total

        best = max(worth(s) for s in itertools.product((0, 1), repeat=len(rows)))
        assert abs(worth(model.decode(rows)) - best) < 1e-9


def test_null_and_repeated_rows(spark):
    page = "<article><p>One is a sentence.</p></article>"
    rows = [(1, "u", page, 9), (1, "u", page, 9), (None, None, None, 1), (2, "v", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "One is a sentence.", 18), (1, "u", "One is a sentence.", 18), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).collect() == []
