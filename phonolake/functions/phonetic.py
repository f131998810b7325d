"""Letter-to-sound rules and expressions over phoneme arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# spelling = phonemes. Our own small fallback for words no lexicon covers;
# the longest spelling wins at each position.
SPELLINGS = """
tion=S @ n    sion=Z @ n    ough=O        augh=O        eigh=eI       igh=aI
tch=tS        sch=S         eau=o         oin=w E~      dge=dZ        eux=2
aux=o         ch=tS         sh=S          th=T          ph=f          wh=w
ng=N          nk=N k        ck=k          qu=k w        gh=g          kn=n
wr=r          ee=i          ea=i          oo=u          ou=aU         ow=aU
oi=OI         oy=OI         ai=eI         ay=eI         au=O          aw=O
ei=aI         ie=i          eu=OI         oa=oU         er=@ r        or=O r
ar=A r        ll=l          ss=s          tt=t          nn=n          rr=r
mm=m          pp=p          ff=f          cc=k          dd=d          gg=g
bb=b          zz=z          a={           b=b           c=k           d=d
e=E           f=f           g=g           h=h           i=I           j=dZ
k=k           l=l           m=m           n=n           o=A           p=p
q=k           r=r           s=s           t=t           u=V           v=v
w=w           x=k s         y=j           z=z           à=a           á=a
â=a           ä=E           ç=s           è=E           é=e           ê=E
ë=E           í=i           î=i           ï=i           ñ=J           ó=o
ô=o           ö=2           ú=u           ù=u           û=y           ü=y
ß=s           œ=2           æ={
"""

# X-SAMPA symbol = IPA symbol, for the symbols the rules can produce.
XSAMPA_TO_IPA = """
S=ʃ   Z=ʒ   @=ə   n=n   O=ɔ   eI=eɪ aI=aɪ tS=t͡ʃ o=o   w=w   E~=ɛ̃  dZ=d͡ʒ
2=ø   T=θ   f=f   N=ŋ   k=k   g=ɡ   i=i   u=u   aU=aʊ OI=ɔɪ oU=oʊ r=ɹ
A=ɑ   l=l   s=s   t=t   m=m   p=p   d=d   b=b   z=z   {=æ   E=ɛ   h=h
I=ɪ   V=ʌ   v=v   j=j   a=a   e=e   J=ɲ   y=y
"""

# The X-SAMPA symbol inventory, in its published order, repeats included.
XSAMPA_INVENTORY = r"""
a b b_< c d d` d_< e f g g_< h h\ i j j\ k l l` m n n` o p p\ q r r\ r\` s s` t t` u v v\ w x x\ y
z z` z\ A B B\ C D E F G G\ G\_< H H\ I I\ J J\ J\_< K K\ L L\ M N N\ O O\ P Q R R\ S T U U\ V
W X X\ Y Z . " % ' : :\ - @ @\ @` { } 1 2 3 3\ 4 5 6 7 8 9 & ? ?\ * / < <\ > >\ ^ ! | |\ ||
|\|\ =\ -\ _" _+ _- _/ _0 _< = _> _?\ _\ _^ _} ` ~ _~ _A _B _a _B_L _c _d _e
<F> _F _G _H _H_T _h _j ') _k _L _l _M _m _N _n _O _o _q <R> <_R_F> _r _T _t _v
_w _X _x ts dz tS dZ ts\ dz\ tK kp gb Nm b_< d_< J\_< g_< G\_< _> p_> t_> k_> s_v
""".split()


def _pairs(table: str) -> list[tuple[str, list[str]]]:
    """Parse a table of ``key=value value`` cells separated by two or more spaces or newlines."""
    cells: list[tuple[str, list[str]]] = []
    for token in table.split():
        head, sep, tail = token.partition("=")
        if sep and head:
            cells.append((head, [tail]))
        else:
            cells[-1][1].append(token)
    return cells


RULES = sorted(_pairs(SPELLINGS), key=lambda rule: -len(rule[0]))
IPA = {symbol: values[0] for symbol, values in _pairs(XSAMPA_TO_IPA)}
GRAPHEME_PATTERN = "|".join(spelling for spelling, _ in RULES)


def _literal_map(items) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in items))


class Rules:
    """Spelling rules in the order in which they are tried: pairs of a spelling and its phonemes.

    The spellings become one pattern of alternatives.
    """

    def __init__(self, pairs: Sequence[tuple[str, Sequence[str]]]):
        self.pairs: dict[str, list[str]] = {}
        for spelling, phonemes in pairs:
            if spelling:
                self.pairs.setdefault(spelling.lower(), list(phonemes))
        self.pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", spelling) for spelling in self.pairs)


def rules_from_table(table: DataFrame, most: int = 20_000) -> Rules:
    """Rules from rows ``rank, grapheme, phonemes``, lowest rank first; a larger table is an error.

    Of rows with the same grapheme the first one counts; null graphemes and phonemes are left out.
    """
    rows = table.select("rank", F.lower("grapheme").alias("grapheme"), "phonemes").dropna(subset=["grapheme", "phonemes"])
    listed = rows.limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} spelling rules")
    listed.sort(key=lambda r: (r["rank"] is None, r["rank"], r["grapheme"], r["phonemes"]))
    return Rules([(r["grapheme"], r["phonemes"]) for r in listed])


def apply_grapheme_rules(word: Column, rules: Rules | None = None) -> Column:
    """Phonemes of a word by spelling rules, at each place the first rule that fits; other characters give nothing.

    Without ``rules`` the built-in ones count, longest spelling first.
    """
    pairs, pattern = (RULES, GRAPHEME_PATTERN) if rules is None else (list(rules.pairs.items()), rules.pattern)
    if not pairs:
        return F.when(word.isNotNull(), F.array().cast("array<string>"))
    table = _literal_map((s, F.array(*[F.lit(p) for p in ps]).cast("array<string>")) for s, ps in pairs)
    pieces = F.regexp_extract_all(F.lower(word), F.lit(pattern), F.lit(0))
    return F.flatten(F.transform(pieces, lambda g: table[g]))


def to_ipa(phonemes: Column) -> Column:
    """X-SAMPA symbols to IPA symbols; unknown symbols pass unchanged."""
    table = _literal_map((s, F.lit(i)) for s, i in IPA.items())
    return F.transform(phonemes, lambda p: F.coalesce(F.try_element_at(table, p), p))


def phonetic_ending(phonemes: Column) -> Column:
    """Last two phonemes, or all of them when there are fewer."""
    return F.slice(phonemes, F.greatest(F.size(phonemes) - 1, F.lit(1)), F.lit(2))


def is_rhyming(left: Column, right: Column) -> Column:
    """Both have at least two phonemes and the last two agree."""
    return (
        (F.size(left) >= 2)
        & (F.size(right) >= 2)
        & (phonetic_ending(left) == phonetic_ending(right))
    )


def rhyme_tail(own: Column, other: Column, longest: int = 3) -> Column:
    """The last ``min(len, len, longest)`` phonemes of ``own``."""
    n = F.least(F.size(own), F.size(other), F.lit(longest))
    return F.when(n > 0, F.slice(own, F.size(own) - n + 1, n)).otherwise(
        F.array().cast("array<string>")
    )
