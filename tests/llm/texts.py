"""Odd texts that every tokenizer query has to get right."""

import random

_rng = random.Random(5)
_ALPHABET = ["a", "b", " ", "  ", "\n", "\t", " ", " ", "́", "é", "é", "中", "\U0001f600", "'s", "'", "1", "23", ".", "?!", "\x1c", "\x00", "​", "﻿", "﷐", "the", " the", "Σ", "İ", "<|endoftext|>", "<|startoftext|>"]
ODD = [None, "", " ", "  a", "a  b", "a b", "a\n b", "it's we'll 'x", "<|endoftext|> a<|endoftext|>b", "< |endoftext|>", "aaaaaaaaaaaaa", "x" * 3000]
ODD += ["".join(_rng.choice(_ALPHABET) for _ in range(_rng.randrange(1, 80))) for _ in range(300)]
ODD += ["".join(_rng.choice("ab") for _ in range(40)) for _ in range(50)]
ODD += [" ".join("".join(_rng.choice("etaoinshr") for _ in range(_rng.randrange(1, 9))) for _ in range(20_000))]
