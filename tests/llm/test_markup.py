"""The labeller on planted documents, on syntax by name, and its training from scratch."""

import numpy as np
import pytest

from siltworks.llm import markup, markup_fit, planting
from siltworks.llm.markup import KINDS, ROLES, Features, Labeller, leaves, load_weights

PROSE = """The old mill stands by the river, and nobody has worked there for years.
When the committee met in March, it decided to keep the records for one more decade.
Der Zug nach Leipzig fährt heute von einem anderen Gleis ab.
Les enfants jouent dans le jardin pendant que la pluie tombe.
La biblioteca abre todos los días menos el domingo por la tarde.
Os barcos voltam ao porto antes do anoitecer, como sempre.
Книга лежит на столе у окна, рядом с письмом.
A careful reader finds three mistakes on the second page.
It rained for most of the week; the market was moved indoors.
Nobody knew who had left the lamp burning in the workshop.""".split("\n")


def kinds(text):
    docs = [leaves(text)]
    p, _ = Labeller(load_weights()).label(docs, Features())[0]
    return {KINDS[k] for k in np.flatnonzero((p >= markup.DECIDE).any(axis=0))}


@pytest.mark.parametrize(
    "text,want",
    [
        ("# A day", "markdown"), ("A long walk\n===========\nIt was far.", "markdown"), ("It was _really_ late.", "markdown"), ("It was __very__ late.", "markdown"), ("See [the page][1] for it.\n[1]: https://h.example/x", "markdown"), ("Write to <https://h.example/x> now.", "markdown"), ("One.\n\n---\n\nTwo.", "markdown"), ("1. one\n2. two", "markdown"), ("`<p>`", "markdown"), ("a ~~wrong~~ word", "markdown"), ("```\n<p>\n\\frac{1}{2}\n```", "markdown"),
        ("see [[X|y]] there", "wiki"), ("{{Infobox town\n| name = Ulm\n}}\n'''Ulm''' is a [[town]].", "wiki"), ("== History ==", "wiki"), ("{| class=\"wikitable\"\n|-\n| a || b\n|}", "wiki"), ("; term : what it means", "wiki"),
        ("\\begin{align} y", "latex"), ("So $x$ is less than $y+1$.", "latex"), ("$x_{1} = \\frac{1}{2}$", "latex"), ("We show \\emph{this} here.", "latex"),
        ("<p>x</p>", "html"), ("one<br>two", "html"), ("Tom &amp; Ann", "html"), ("<pre>\n# x\n[[a]]\n</pre>", "html"),
        ("a < b and c > d", ""), ("costs $9 in May and $9 in June", ""), ("C:\\temp\\new on it", ""), ("grid[9][9] = 9", ""), ("2 * 3 * 4 under max_page_count", ""), ("Dear {{ name }}, hi", ""), ("Home | News | About us", ""), ("", ""),
    ],
)
def test_syntax(text, want):
    assert kinds(text) == ({want} if want else set())


def test_held_out_planted_documents():
    docs = [markup_fit.labelled(d) for d in planting.documents(PROSE, 400, 77)]
    for kind, (p, r, dp, dr) in markup_fit.scores(Labeller(load_weights()), docs).items():
        assert min(p, r, dp, dr) >= 0.97, (kind, p, r, dp, dr)


def test_roles_of_planted_documents():
    docs = [markup_fit.labelled(d) for d in planting.documents(PROSE, 300, 78)]
    got = np.concatenate([r for _, r in Labeller(load_weights()).label([d for d, _, _ in docs], Features())])
    assert (got == np.concatenate([r for _, _, r in docs])).mean() >= 0.95


def test_fit_from_scratch_learns():
    labeller, scores = markup_fit.fit(["\n".join(PROSE)] * 3, train=500, epochs=6)
    assert np.mean(list(scores.values())) > 0.85


def test_context_decides():
    alone = leaves("* " + PROSE[0])
    assert kinds("{{ name }}\n" + PROSE[0]) == set()
    assert len(alone) == 1 and ROLES[Labeller(load_weights()).label([alone], Features())[0][1][0]] == "list"


def test_clean_text_keeps_structure():
    text = "# Title\n\n- **one**\n- two\n\n```\nx = [[1]]\n```\n\n$$a_{1}$$\n\nSee [this](/x)."
    doc = leaves(text)
    assert markup.clean_text(doc, Labeller(load_weights()).label([doc], Features())[0][1]) == "# Title\n- one\n- two\n```\nx = [[1]]\n```\n$$a_{1}$$\nSee this."
