"""The most likely path of a conversation against all paths there are."""

import itertools
import math
import random

import pytest

from marquee.llm import chat

LINES = ["Why?", "It is so.", "User: no", "Assistant: yes", "Anna: perhaps", "", "### System", "a long line of words " * 12]


def models():
    """One from counts, one that has seen nothing, and one in which turns within a row are easily told."""
    rng = random.Random(5)
    n = range(len(chat.ROLES))
    seen = {(r, f, c): rng.randrange(40) for r in n for f in (0, 1) for c in range(len(chat.MARKERS) * chat.SHAPES)}
    turns = {(q, r): rng.randrange(50) for q in n for r in n}
    return [chat.model(chat.ROLES, {0: 1, 1: 9, 2: 30}, turns, seen), chat.model(chat.ROLES, {}, {}, {})]


def score(rows, states, m):
    """The log chance of lines and states, written down term by term."""
    total, before = 0.0, None
    for known, lines in zip(rows, states, strict=True):
        for i, (code, (role, opens)) in enumerate(zip(known, lines, strict=True)):
            if i == 0:
                total += (m.start[role] if before is None else m.turn[before][role]) + m.first[role][code]
            elif opens:
                total += math.log(chat.SWITCH / len(m.roles)) + m.opening[role][code]
            else:
                total += math.log(1 - chat.SWITCH) + m.inside[role][code]
            before = role
    return total


def every_path(rows, m):
    """All states of all lines: a row's first line opens a turn, a later one may, or goes on with the role before."""

    def of_row(n):
        roles = range(len(m.roles))
        for first, *later in itertools.product(roles, *[(None, *roles)] * (n - 1)):
            lines = [(first, True)]
            for role in later:
                lines.append((lines[-1][0], False) if role is None else (role, True))
            yield lines

    return itertools.product(*[list(of_row(len(known))) for known in rows])


@pytest.mark.parametrize("m", models(), ids=["counts", "nothing seen"])
def test_path_is_the_best_of_all(m):
    rng = random.Random(3)
    for sizes in [(1,), (3,), (1, 1, 1, 1), (2, 3), (3, 2), (1, 3, 1), (4,)] * 4:
        rows = [[c for _ in range(n) for c in chat.codes(rng.choice(LINES))] for n in sizes]
        states, _ = chat.path(rows, m, None, None)
        best = max(score(rows, states_, m) for states_ in every_path(rows, m))
        assert score(rows, states, m) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("m", models(), ids=["counts", "nothing seen"])
def test_path_to_a_given_end_is_the_best_that_ends_so(m):
    rng = random.Random(4)
    for last in range(len(m.roles)):
        for sizes in [(2,), (1, 2), (2, 1, 1)]:
            rows = [[c for _ in range(n) for c in chat.codes(rng.choice(LINES))] for n in sizes]
            states, _ = chat.path(rows, m, None, last)
            assert states[-1][-1][0] == last
            best = max(score(rows, s, m) for s in every_path(rows, m) if s[-1][-1][0] == last)
            assert score(rows, states, m) == pytest.approx(best, abs=1e-9)


def test_scores_through_rows_are_those_of_the_best_paths():
    m = models()[0]
    rows = [chat.codes("Why?\nUser: no\nso"), chat.codes("Assistant: yes\nBecause.")]
    scores = chat.through(rows, m, None)
    for last, found in enumerate(scores):
        assert found == pytest.approx(max(score(rows, s, m) for s in every_path(rows, m) if s[-1][-1][0] == last), abs=1e-9)
