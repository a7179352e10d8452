"""Personal data: time by length, and recall and precision of the kinds that the method adds."""

import random
import time

import pytest

from speechtable.llm import pii

UNITS = ["9", "account a ", "ssn 1 1-", "ab@cd.ef ", "a@", "1.1.1.", "+1(2) 3", "://a:", "account \t ", "://~a/", "1 2-"]


@pytest.mark.parametrize("unit", UNITS)
def test_time_grows_with_the_length(unit):
    def seconds(n):
        text = (unit * (n // len(unit) + 1))[:n]
        best = []
        for _ in range(2):
            began = time.perf_counter()
            pii.spans(text)
            best.append(time.perf_counter() - began)
        return min(best)

    seconds(1000)
    assert seconds(1_000_000) < 8 * max(seconds(250_000), 0.02)  # four times the text; sixteen times if it were quadratic


def test_added_kinds_recall_and_precision():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made, missed, extra = 0, 0, 0
    for _ in range(400):
        name = word(rng.randint(4, 12)) + rng.choice(["", "_", "7"]) + digits(rng.randint(0, 3))
        number = rng.choice([digits(rng.randint(6, 22)), "DE" + digits(4) + " " + digits(4) + " " + digits(4), "X" + digits(7), digits(4) + "-" + digits(6)])
        wanted = {
            "handle": (rng.choice(["thanks ", "(", "by "]), "@" + name, rng.choice([" said", ")", ", and"])),
            "login": ("see https://", f"{name}:{word(6)}", f"@{word(7)}.com/x"),
            "profile": ("see https://", f"www.{word(7)}.org/{rng.choice(['~', '@', 'u/', 'users/', 'people/'])}{name}", rng.choice([" ", "/posts", "?x=1"])),
            "account": (f"the {rng.choice(['account', 'IBAN', 'Customer ID', 'passport', 'Tax ID'])}{rng.choice([': ', ' no. ', ' number ', ' #', ' '])}", number, rng.choice([" was", ", then", "."])),
        }
        text, places = "", []
        for kind, (before, what, after) in rng.sample([*wanted.items()], 4):
            text += rng.choice(["", "on account of the rain, ", "accountant 12345, ", "a user id is needed; ", "http://plain.org/users, ", "mail a.b@cd.org; ", "C@T, @ 5, x@@y; ", "on the house "]) + before
            places.append((len(text), pii.KINDS.index(kind), len(text) + len(what)))
            text += what + after + " " + word(5) + " "
        base, all_ = pii.spans(text)
        found = set(all_) - set(base)
        made += len(places)
        missed += len(set(places) - found)
        extra += len(found - set(places))
    assert missed <= 0.03 * made and extra <= 0.03 * made, (made, missed, extra)


def test_long_names_and_numbers_are_whole():
    name, number = "n" * 200, "1" * 200
    text = f"by @{name} account: {number} end"
    assert (3, pii.KINDS.index("handle"), 204) in pii.spans(text)[1]
    assert (text.index(number), pii.KINDS.index("account"), text.index(number) + 200) in pii.spans(text)[1]
