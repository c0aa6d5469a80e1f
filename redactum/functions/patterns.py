"""Regular expressions shared by Spark (Java regex) and the DuckDB oracle (RE2).

Bare ``\\w``, ``\\s`` and ``\\b`` mean different things in Python, Java and RE2,
so the classes are spelled out: ``WORD_CLASS`` is Python's ``\\w`` and
``SPACE_CLASS`` is Python's ``\\s``. Every pattern here compiles unchanged in
both engines.
"""

# --- fixed values (must equal the reference's behaviour) -------------------
# Python's \w and \s as explicit Unicode classes.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"
# Token alternatives, in this order: a lower-case abbreviation of 1-4 letters
# (Polish letters included) with its dot; words joined by hyphens; one symbol.
POLISH_LOWER = "ąćęłńóśźż"
ABBREVIATION = r"[a-z" + POLISH_LOWER + r"]{1,4}\."
# Title words removed before a name is normalised (two passes, in this order).
TITLES_PASS_1 = r"dr\.?|prof\.?|mgr\.?|inż\.?|hab\.?|adw\.?|r\.pr\.?"
TITLES_PASS_2 = r"pan|pani|minister|sędzi[aeo]|radcy?|radcę|świadek|mał\.?|małoletniego?"
# The 29 characters of Python's \s, listed (for rtrim, which takes a set).
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Letter fold used by the initials shift (upper-cased input; note the swap of
# case in the target, which shifts Polish capitals by six letters).
FOLD_FROM = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
FOLD_TO = "ACELNOSZZacelnoszz"
# Letter-true fold (option fold="letter"): every Polish letter to its base capital.
FOLD_TO_LETTER = "ACELNOSZZACELNOSZZ"
# ---------------------------------------------------------------------------

WORD = rf"[{WORD_CLASS}]+(?:-[{WORD_CLASS}]+)*"
SYMBOL = rf"[^{WORD_CLASS}{SPACE_CLASS}]"
TOKEN = f"{ABBREVIATION}|{WORD}|{SYMBOL}"
SPACES = rf"[{SPACE_CLASS}]*"
# One match = one token (group 1) plus the whitespace that follows it
# (group 2). Only leading whitespace of a text is left outside the matches.
TOKEN_WITH_TRAIL = rf"({TOKEN})({SPACES})"
# Java twin with a possessive abbreviation quantifier: equivalent (a shorter
# run of letters is always followed by a letter, never by the dot), but it
# stops the regex from backtracking through every lower-case word.
TOKEN_WITH_TRAIL_JAVA = TOKEN_WITH_TRAIL.replace(r"]{1,4}\.", r"]{1,4}+\.", 1)
LEADING_SPACE = rf"^[{SPACE_CLASS}]*"
EDGE_SPACE = rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"
TRAILING_SPACE = rf"[{SPACE_CLASS}]+$"
SPACE_RUN = rf"[{SPACE_CLASS}]+"
NOT_SPACE = rf"[^{SPACE_CLASS}]"
NOT_WORD = rf"[^{WORD_CLASS}]"

# Markup is cut into maximal stretches without angle brackets and the single
# brackets themselves; concatenated, the pieces give back the document.
MARKUP_PIECE = r"[^<>]+|[<>]"

# Title stripping. Spark (Java) uses a look-behind for Python's \b; RE2 has no
# look-behind, so the oracle captures the preceding character and re-emits it,
# consuming consecutive titles in one match.
TITLES_1_JAVA = rf"(?iu)(?<![{WORD_CLASS}])(?:{TITLES_PASS_1})[{SPACE_CLASS}]+"
TITLES_2_JAVA = rf"(?iu)(?<![{WORD_CLASS}])(?:{TITLES_PASS_2})[{SPACE_CLASS}]+"
TITLES_1_RE2 = rf"(^|[^{WORD_CLASS}])(?:(?:{TITLES_PASS_1})[{SPACE_CLASS}]+)+"
TITLES_2_RE2 = rf"(^|[^{WORD_CLASS}])(?:(?:{TITLES_PASS_2})[{SPACE_CLASS}]+)+"

# Tagged mentions in redacted markup; both quote styles, attribute optional.
MENTION_TAG_JAVA = r"(?s)<xAnon(?:\s+xSubst=(?:'([^']*)'|\"([^\"]*)\"))?\s*>(.*?)</xAnon>"
