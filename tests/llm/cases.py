"""Small tables that hold the awkward cases."""

import random


def texts(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, repeats, empty and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(80)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = text(40)
    base = text(120)
    out = ["", " \n\t ", "x", shared, base, base, "hello " * 300, text(3000)]
    for _ in range(n):
        kind = rng.randint(0, 4)
        if kind == 0:
            out.append(text(rng.randint(0, 60)) + " " + shared + "\n" + text(rng.randint(0, 60)))
        elif kind == 1:
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        elif kind == 2 and len(out) > 9:
            out.append(rng.choice(out))
        else:
            out.append(text(rng.randint(1, 150)))
    return out


def documents(spark, rows=None, seed=0):
    """``doc_id, text, lang, source, n_chars`` in shuffled order, with clashing extra columns."""
    if rows is None:
        rows = list(enumerate(texts(seed)))
    full = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if (i or 0) % 7 else None, len(t or ""), i, "z", 1) for i, t in rows]
    random.Random(1).shuffle(full)
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, seen string, size int"
    return spark.createDataFrame(full, schema).repartition(3)


#: Null ids, null texts, repeated ids with other texts, equal rows.
ODD = [(None, "a b c " * 40), (None, None), (1, "a b c " * 40), (1, "a b c " * 40), (1, None), (2, "q w e r t " * 30), (2, "a b c " * 40), (3, "")]


def ordered(rows):
    """Rows as the operators order them: by id, nulls last, then by text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def thue_morse(n):
    """Two different words of 2**n letters whose polynomial hashes modulo 2**64 are equal at any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
