"""The models of ordinary tokens that the fixed tables of the secret scan were counted from, and its statistic in numpy."""

import numpy as np

#: Letter frequencies of English in percent, a to z.
LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, .15, .77, 4.0, 2.4, 6.7, 7.5, 1.9, .095, 6.0, 6.3, 9.1, 2.8, .98, 2.4, .15, 2.0, .074])
VOWEL = np.isin(np.arange(26), [0, 4, 8, 14, 20, 24])
#: Chance of a vowel at first, after a consonant, and after a vowel.
VOWEL_CHANCES = 0.38, 0.54, 0.13


def minus_two_log(z):
    x = np.abs(z)
    odds = 1.5976 * x + 0.070565992 * x ** 3
    return 2 * np.where(odds > 30, odds, np.log1p(np.exp(np.minimum(odds, 700)))) - 2 * np.log(2)


def bins(v, alphabet, high):
    """Bin of each row of symbols: chi-squared, runs of ``high`` and serial correlation, summed as Fisher does."""
    n = v.shape[1]
    squares = sum((v == s).sum(1).astype(float) ** 2 for s in np.unique(v))
    chi = (squares * alphabet / n - n - (alphabet - 1)) / np.sqrt(2 * (alphabet - 1))
    h = high.sum(1)
    runs = (high[:, 1:] != high[:, :-1]).sum(1) + 1.0
    wanted = 2 * h * (n - h) / n + 1
    spread = (wanted - 1) * (wanted - 2) / (n - 1)
    z = np.where(spread > 0, (runs - wanted) / np.sqrt(np.maximum(spread, 1e-9)), 9)
    d = v - v.mean(1, keepdims=True)
    s = (d * d).sum(1)
    serial = np.where(s > 0, ((d[:, 1:] * d[:, :-1]).sum(1) / np.maximum(s, 1e-9) + 1 / n) * np.sqrt(n), 9)
    total = minus_two_log(np.maximum(chi, 0)) + minus_two_log(z) + minus_two_log(serial)
    return np.minimum(np.floor(total * 4), 400).astype(int)


def above_median(v):
    return v >= np.sort(v, axis=1)[:, v.shape[1] // 2][:, None]


def independent_letters(r, rows, n):
    return r.choice(26, (rows, n), p=LETTERS / LETTERS.sum())


def spoken_letters(r, rows, n):
    """Letters of English frequency where vowels and consonants take turns as in words."""
    of = [np.where(VOWEL, 0, LETTERS), np.where(VOWEL, LETTERS, 0)]
    first, after_consonant, after_vowel = VOWEL_CHANCES
    out, now = np.zeros((rows, n), int), r.random(rows) < first
    for j in range(n):
        if j:
            now = r.random(rows) < np.where(now, after_vowel, after_consonant)
        out[:, j] = np.where(now, r.choice(26, rows, p=of[1] / of[1].sum()), r.choice(26, rows, p=of[0] / of[0].sum()))
    return out


def like_words(v):
    """At most five consonants in a row, and a vowel in four letters."""
    row, longest = np.zeros(len(v), int), np.zeros(len(v), int)
    for j in range(v.shape[1]):
        row = np.where(VOWEL[v[:, j]], 0, row + 1)
        longest = np.maximum(longest, row)
    return (longest <= 5) & (VOWEL[v].mean(1) >= 0.25)


def highest_bins(found, shares, rows):
    """For each share of ``rows`` the highest bin that it does not exceed (-1: none)."""
    counts = np.cumsum(np.bincount(found, minlength=402))
    return [int(np.searchsorted(counts, p * rows, side="right")) - 1 if counts[-1] > p * rows else 400 for p in shares]


def letter_row(r, n, shares, rows=100_000):
    v = spoken_letters(r, rows, n)
    v = v[~like_words(v)]
    return highest_bins(bins(v, 26, VOWEL[v]), shares, rows)


def word_row(r, n, shares, rows=200_000):
    lower, upper = independent_letters(r, rows, n) + 97, independent_letters(r, rows, n) + 65
    weights = np.bincount(bins(lower, 62, above_median(lower)), minlength=402) * 0.9 + np.bincount(bins(upper, 32, above_median(upper)), minlength=402) * 0.1
    total = np.cumsum(weights)
    return [int(np.searchsorted(total, p * rows, side="right")) - 1 for p in shares]
