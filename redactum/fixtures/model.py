"""A deterministic stand-in for a token-classification model, for tests and
the hosted-model query: it applies the test-table rule to a run's word list
in Python, so its output can be checked against the JVM rule recognizer.
Production code passes a real model factory to ``model_labels``."""

from __future__ import annotations

from .rules import PREPOSITIONS, TRANSPARENT_SYMBOL


def rule_model_factory():
    import regex

    kinds = regex.compile(r"^(?:(?P<cap3>\p{Lu}\p{Ll}{2,})|(?P<caps>\p{Lu}{3,})|(?P<digits>[0-9]{9,}))$")
    preps = set(PREPOSITIONS)
    outside = [("O", 0.5 + k * 0.125) for k in range(5)]

    def kind(w):
        m = kinds.search(w)
        return m.lastgroup if m is not None else TRANSPARENT_SYMBOL if w == TRANSPARENT_SYMBOL else None

    def predict(runs):
        words_of_call = set().union(*runs)
        plain = {w: outside[len(w) % 5] for w in words_of_call}
        # a word of no kind is O whatever stands beside it; none begins with a small letter
        known = {w: k for w in words_of_call if not "a" <= w[:1] <= "z" and (k := kind(w)) is not None}
        out = []
        for words in runs:
            labs = list(map(plain.__getitem__, words))
            for i in [i for i, w in enumerate(words) if w in known]:
                w, own = words[i], known[words[i]]
                prev = words[i - 1] if i > 0 else None
                nxt = words[i + 1] if i + 1 < len(words) else None
                if own == "digits":
                    lab = "B-SENSITIVE"
                elif own == "caps" and nxt == "License":
                    lab = "B-PRODUCT"
                elif w == "License" and known.get(prev) == "caps":
                    lab = "I-PRODUCT"
                elif own == "cap3" and known.get(prev) == "cap3":
                    lab = "I-PERSON"
                elif own == "cap3" and known.get(nxt) == "cap3":
                    lab = "B-PERSON"
                elif own == "cap3" and prev in preps:
                    lab = "B-LOCATION"
                elif own == TRANSPARENT_SYMBOL:
                    lab = "MAIL"
                else:
                    continue
                labs[i] = (lab, plain[w][1])
            out.append(labs)
        return out

    return predict


def fragile_model_factory():
    """The same model, but one that raises on a run with a long digit run
    (for the failure queries)."""
    import regex

    digits = regex.compile(r"^[0-9]{9,}$")
    rule = rule_model_factory()

    def predict(runs):
        for words in runs:
            for w in words:
                if len(w) >= 9 and "0" <= w[0] <= "9" and digits.search(w):
                    raise ValueError(f"cannot read {w}")
        return rule(runs)

    return predict
