"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mentions and links that no ASCII word character precedes; runs of word characters; letters beyond ASCII that have
#: an ASCII letter in lower case.
MENTION_OR_LINK = r"(?:@|https?://)(?<![A-Za-z0-9_](?:@|https?://))[^ \t\n\x0B\f\r]+"
WORD = r"[A-Za-z0-9_]+"
NOT_ASCII = "\u0130\u212a"


def _bare(text: Column) -> Column:
    """Text without mentions and links."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), MENTION_OR_LINK, " ")


def clean_words(text: Column) -> Column:
    """Lower-case words in order, without mentions, links and punctuation; null text has none."""
    bare = _bare(text)
    for c in NOT_ASCII:
        bare = F.replace(bare, F.lit(c), F.lit(" "))
    return F.regexp_extract_all(F.lower(bare), F.lit(WORD), F.lit(0))


def has_words(text: Column) -> Column:
    """Whether there are cleaned words, without listing them."""
    return _bare(text).rlike("[A-Za-z0-9_]")


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(clean_words(text)))


def word_tokens(text: Column) -> Column:
    r"""All runs of ASCII word characters, ``\w+``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def each_word(df: DataFrame, words: str, name: str, *cols: str) -> DataFrame:
    """``cols``, ``pos`` and the word (``name``): a row for each of a column of lists.

    After ``explode`` Catalyst tests first, and where texts are read, that a list isn't empty, and so lists each text's words twice; the outer form
    is spared it.
    """
    return df.select(*cols, F.posexplode_outer(words).alias("pos", name)).where("pos is not null")


#: Letters of Latin-1 and Latin Extended-A that fold to one ASCII letter.
FOLD_FROM = (
    "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĦħĨĩĪīĬĭĮįİ"
    "ıĴĵĶķĹĺĻļĽľŁłŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŦŧŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
)
FOLD_TO = (
    "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyyAaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhHhIiIiIiIiI"
    "iJjKkLlLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtTtUuUuUuUuUuUuWwYyYZzZzZz"
)


def ascii_fold(text: Column) -> Column:
    """Latin letters without their marks; other characters beyond ASCII go."""
    two = F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(F.translate(two, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


# --- social-media tokens ---------------------------------------------------

#: Fixed values of the rewriting rules.  A face is eyes, nose, mouth, or the reverse; the first form needs a blank
#: before it only, the second a blank after it only.
EYES = r"[8:=;]"
NOSE = r"['`\-\^]?"
MOUTHS = (
    (r"[(\[/\\]+", r"[)\]/\\]+", "<sadface>"),
    (r"[)\]]+", r"[(\[]+", "<smile>"),
    (r"[DbpP]+", r"[d]+", "<lolface>"),
    (r"[|]+", r"[|]+", "<neutralface>"),
)
LINK = r"(?:(?:https?|ftp)://|www\.)[^\s]+"
NUMBER = r"[-+]?[.\d]*[\d]+[:,.\d]*"
MARKS = r"""'!"#$%&'()+,/:;=?@_`{|}~\*\-\.\^\\\[\]"""
#: A run of marks and blanks from its first mark; blanks alone stand between blanks already.
PUNCTUATION = f"[{MARKS}][ {MARKS}]*"
SPACE = r"[ \t\n\x0B\f\r]+"
#: An elongation is looked for from a blank, or from the one before, since a match from further right begins there as well.
ELONGATION = r"(?:\G|(?<!\S))(\S*?)([A-Za-z0-9_])\2+(?![A-Za-z0-9_])"
#: What may end a token behind the place that ``$`` finds.
LINE_END = r"[\u0085\u2028\u2029]?"


def tokenize(text: Column) -> Column:
    """Tokens of a message: links, users, hashtags, faces, hearts, numbers, punctuation, repeats and elongations marked.

    Rules apply in order; each result stands between blanks.  Null text has no tokens.
    """
    s = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        s = F.replace(s, F.lit(c), F.lit(" "))
    s = F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" "))  # two blanks at least between tokens
    has_tags = s.rlike(f" #[A-Za-z0-9_]+{LINE_END} ")
    links = F.regexp_replace(s, r" (?:(?:https?|ftp)://|www\.)\S+", " <url>")
    s = F.when(has_tags, _tags(s)).otherwise(F.regexp_replace(links, f" @[A-Za-z0-9_]+{LINE_END}(?= )", " <user>"))
    faces = s
    for front, back, mark in MOUTHS:
        faces = F.regexp_replace(faces, rf"(?:\s|^){EYES}{NOSE}{front}|{back}{NOSE}{EYES}(?:\s|$)", f" {mark} ")
    s = F.when(text.rlike(EYES), faces).otherwise(s)
    s = F.regexp_replace(s, r"(?:\s|^)(?:<3+)+(?:\s|$)", " <heart> ")
    s = F.regexp_replace(F.lower(s), rf"((?:\s|^){NUMBER}(?:\s|$))", " $1 <number> ")
    s = F.regexp_replace(s, f"({PUNCTUATION})", " $1 ")
    s = F.regexp_replace(s, r"([!?.])\1+", " $1 <repeat> ")
    s = F.regexp_replace(s, ELONGATION, " $1$2 <elong> ")
    s = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_fold(s)).otherwise(s)
    return F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))


def _tags(s: Column) -> Column:
    """The rules of whole tokens one by one, for texts with hashtags."""
    parts = F.filter(F.split(s, SPACE), lambda x: x != "")
    return F.concat(F.lit(" "), F.array_join(F.transform(parts, _whole_token), "  "), F.lit(" "))


def _whole_token(t: Column) -> Column:
    tag = F.substring(t, 2, 1 << 20)
    camel = F.trim(F.regexp_replace(F.regexp_replace(tag, r"^[^a-zA-Z]+", ""), r"([a-zA-Z][^A-Z]*)", " $1"))
    body = F.when(tag == F.upper(tag), tag).otherwise(camel)
    return (
        F.when(t.rlike(f"^{LINK}$"), F.lit("<url>"))
        .when(t.rlike(r"^@[A-Za-z0-9_]+$"), F.lit("<user>"))
        .when(t.rlike(r"^#[A-Za-z0-9_]+$"), F.concat(F.lit("<hashtag>  "), body, F.lit("  <endhashtag>")))
        .otherwise(t)
    )
