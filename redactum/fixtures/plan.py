"""The redaction plan with the recognizer and the dictionary of the test tables."""

from __future__ import annotations

from ..plans.pipeline import Redaction
from .lexicon import rule_lemmas
from .rules import rule_labels, rule_prefilter


def fixture_redaction(docs, lemmas=rule_lemmas, recognizer=rule_labels, prefilter=None, **options) -> Redaction:
    if prefilter is None and recognizer is rule_labels:
        prefilter = rule_prefilter
    options.setdefault("rowwise", recognizer is rule_labels)
    return Redaction(docs, lemmas, recognizer, prefilter=prefilter, **options)
