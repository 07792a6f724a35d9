"""Grammars of six languages over token classes of one character each.

A grammar is a list of productions, written as regular expressions over token classes. Bracketed parts are single symbols on
the level around them (``P`` round, ``S`` square, ``B`` curly, ``D`` an indented block), so that every level is a regular language.
From the productions come

* the permissible pairs of adjacent tokens (``permissible_pairs``), from the first and last tokens of the productions
  (a least fixed point) and the contents of each bracket;
* the statement forms that a whole statement, or the contents of a round or square bracket, must match (``FORMS``).
  Within them an expression is any run of the symbols that expressions consist of: the pairs have already
  checked its order.
"""

from __future__ import annotations

import functools
import re

BEGIN, END = "^", "$"
OPEN = {"P": "(", "S": "[", "B": "{", "D": "\x01"}
CLOSE = {"P": ")", "S": "]", "B": "}", "D": "\x02"}


class _Parser:
    """Reads a production: literals, classes, groups, ``| * + ?`` and references ``<NAME>`` to other productions."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def alternatives(self) -> tuple:
        out = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def sequence(self) -> tuple:
        out = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            out.append(self.repeated())
        return ("then", out)

    def repeated(self) -> tuple:
        text, c = self.text, self.text[self.at]
        if text.startswith("(?:", self.at):
            self.at += 3
            out = self.alternatives()
            assert text[self.at] == ")", text[self.at :]
            self.at += 1
        elif c == "[":
            stop = text.index("]", self.at)
            out = ("one", frozenset(text[self.at + 1 : stop].replace("\\", "")))
            self.at = stop + 1
        elif name := re.compile(r"<([A-Z]{2,})>").match(text, self.at):
            out = ("name", name[1])
            self.at = name.end()
        elif c == "\\":
            out = ("one", frozenset(text[self.at + 1]))
            self.at += 2
        else:
            out = ("one", frozenset(c))
            self.at += 1
        while self.at < len(text) and text[self.at] in "*+?":
            out = (text[self.at], out)
            self.at += 1
        return out


def _read(text: str) -> tuple:
    p = _Parser(text.replace(" ", ""))
    out = p.alternatives()
    assert p.at == len(p.text), p.text[p.at :]
    return out


def _sets(node: tuple, known: dict, pairs: set | None = None) -> tuple[bool, frozenset, frozenset]:
    """Whether a node may be empty, its first and its last tokens; the pairs within it are added to ``pairs``."""
    kind = node[0]
    if kind == "one":
        return False, frozenset(OPEN.get(c, c) for c in node[1]), frozenset(CLOSE.get(c, c) for c in node[1])
    if kind == "name":
        return known[node[1]]
    if kind == "or":
        parts = [_sets(x, known, pairs) for x in node[1]]
        return any(p[0] for p in parts), frozenset().union(*(p[1] for p in parts)), frozenset().union(*(p[2] for p in parts))
    if kind == "then":
        out = (True, frozenset(), frozenset())
        for x in node[1]:
            b = _sets(x, known, pairs)
            if pairs is not None:
                pairs |= {(l, f) for l in out[2] for f in b[1]}
            out = out[0] and b[0], out[1] | b[1] if out[0] else out[1], out[2] | b[2] if b[0] else b[2]
        return out
    empty, first, last = _sets(node[1], known, pairs)
    if pairs is not None and kind in "*+":
        pairs |= {(l, f) for l in last for f in first}
    return empty or kind in "*?", first, last


def permissible_pairs(rules: dict[str, str], levels: dict[str, str]) -> set[tuple[str, str]]:
    """Adjacent token pairs that the grammar allows. ``levels`` names the contents of each bracket and of the file (``top``)."""
    trees = {name: _read(text) for name, text in rules.items()}
    known = {name: (False, frozenset(), frozenset()) for name in rules}
    while True:  # the least fixed point: productions may refer to each other
        new = {name: _sets(tree, known) for name, tree in trees.items()}
        if new == known:
            break
        known = new
    out: set[tuple[str, str]] = set()
    for tree in trees.values():
        _sets(tree, known, out)
    for bracket, text in levels.items():
        empty, first, last = _sets(_read(text), known, out)
        begin, end = (BEGIN, END) if bracket == "top" else (OPEN[bracket], CLOSE[bracket])
        out |= {(begin, f) for f in first} | {(l, end) for l in last}
        if empty:
            out.add((begin, end))
    return out


# --- JavaScript and TypeScript -------------------------------------------------------------------------------
# i name, l literal, . member access, k ++/--, u prefix only, s + and -, x *, b binary, = assignments, G arrow, q spread,
# N in/instanceof/of/as, w new, a await/typeof/void/delete, A async, m member modifiers, z yield, F function, K class, X extends,
# I if, E else, L for, W while, O do, T switch, C case, d default, R return, t throw, Y try, c catch, y finally, J break/continue,
# v let/var, V const, M import, f from, e export, Q interface/namespace, H type, U enum, @ decorator
_JS = {
    "TERM": r"(?:[usakwqzx]|A?(?:i|P)G)*(?:i|l|z|P|S|B|A?Fx?i?PB|Ki?(?:X(?:i|P)(?:\.i|P|S)*)?B)(?:\.i|P|S|k|l|\.P|\.S)*",
    "EX": r"<TERM>(?:[bsx<>=?:N]<TERM>)*",
    "LIST": r"(?:<EX>(?:,<EX>)*,?)?",
    "MEMBER": r"(?:@P?)*m*A?m*x?(?:i|l|S)(?:PB|=<EX>)?",
    "PROPERTY": r"m*A?x?(?:i|l|S)(?:PB|:<EX>)?|q<EX>|i=<EX>",
    "SIMPLE": r"<EX>(?:,<EX>)*|[vV]<EX>(?:,<EX>)*|R(?:<EX>(?:,<EX>)*)?|t<EX>|Ji?|WP|M(?:l|(?:i|B|xNi)(?:,(?:B|xNi))?fl)|ed<EX>|eB(?:fl)?|ex(?:Ni)?fl|<MEMBER>",
    "BLOCK": r";|@P?|IP|WP|La?P|E|O|i:|C<EX>:|d:|YB(?:cP?B)?(?:yB)?|TPB|A?Fx?i?PB|Ki?(?:X<EX>)?B|e|ed|m*A?x?(?:i|l|S)PB|m*B|B",
    "ITEM": r"<BLOCK>|<SIMPLE>;",
    "TAIL": r"<SIMPLE>|<PROPERTY>(?:,<PROPERTY>)*,?",
    "ROUND": r"<LIST>|[vV]<LIST>|[vV]?<LIST>;<LIST>;<LIST>|[vV]<EX>N<EX>",
    "SQUARE": r",*(?:<EX>(?:,+<EX>)*,*)?",
}
_TS = _JS | {
    "TERM": r"(?:[usakwqzxmN]|A?(?:i|P)G|<ARGS>)*(?:i|l|z|P|S|B|A?Fx?i?<ARGS>?P(?:b?:<EX>)?B|Ki?(?:X<EX>)*B)(?:\.i|P|S|k|l|u|\.P|\.S|<ARGS>)*",
    "ARGS": r"[<](?:i(?:X<EX>)?|<EX>)(?:,<EX>)*>+",
    "EX": r"<TERM>(?:[bsx<>=?:NX]<TERM>|<TERM>G<TERM>|\?:<TERM>|u:<TERM>)*(?:<ARGS>|\?|:P?G<TERM>)?",
    "MEMBER": r"(?:@P?)*m*A?m*x?(?:i|l|S)?\??u?<ARGS>?(?:P(?::<EX>)?B?|:<EX>)?(?:=<EX>)?[;,]?",
    "SIMPLE": _JS["SIMPLE"] + r"|Hi<ARGS>?=b?<EX>|MHBfl|eHB(?:fl)?|A?Fx?i?<ARGS>?P(?::<EX>)?|Mi=<EX>|m*S:<EX>",
    "BLOCK": _JS["BLOCK"] + r"|m|[QUK]i<ARGS>?(?:X<EX>(?:,<EX>)*)*B|A?Fx?i<ARGS>?P(?::<EX>)?B|QlB|m*A?x?(?:i|l|S)\??<ARGS>?P(?::<EX>)?B",
    "TAIL": r"<SIMPLE>|<PROPERTY>(?:,<PROPERTY>)*,?|<MEMBER>(?:,<MEMBER>)*,?|<ARGS>?P(?::<EX>)?",
    "ROUND": _JS["ROUND"] + r"|m*<EX>(?:,m*<EX>)*,?",
}


_JSE = r"[ilPSBGkusxb=<>?:.,qNwaAmzFKX@]"
_JS_PREFIX = r"(?:IP|WP|La?P|E|O|i:|C[^CdIELWTR;]*?:|d:)*"
_JS_FORMS = {
    "P": rf"[vV]?{_JSE}*|[vV]?{_JSE}*;{_JSE}*;{_JSE}*",
    "S": rf"{_JSE}*",
    "B": rf"{_JS_PREFIX}(?:;|{_JSE}+;?|v{_JSE}+;?|V(?=.*=){_JSE}+;?|R{_JSE}*;?|t{_JSE}+;?|Ji?;?|B(?:E(?:IPB|B)?)*|YB(?:cP?B(?:yB)?|yB)|OBWP;?|TPB|M(?:l|{_JSE}+fl);?|e?d?A?Fx?i?PB;?|e?d?Ki?(?:X[^;]+)?B;?|ed{_JSE}+;?|e[vV]{_JSE}+;?|eB(?:fl)?;?|exN?i?fl;?|{_JS_PREFIX})",
}
_TS_FORMS = {
    "P": rf"[vV]?[^;]*|[vV]?[^;]*;[^;]*;[^;]*",
    "S": r"[^;]*",
    "B": rf"e?d?m*{_JS_PREFIX}(?:{_JS_FORMS['B']}|e?d?A?Fx?i?[^;]*[B;]|e?m*[QUK]i?[^;]*B;?|e?Hi[^;]*=[^;]+;?|MH?{_JSE}*fl;?|eH?B(?:fl)?;?|Q[il.]+B|@?{_JSE}*;?)",
}

# --- Java -----------------------------------------------------------------------------------------------------
# p primitive type, m modifier, K class/interface/enum/record, X extends/implements/permits, h throws, a package, M import, r ::,
# G ->, Z assert, n synchronized
_JAVA = {
    "TAIL": r"",
    "TARGS": r"[<](?:[ip?&,.@X<>]|S)*>",
    "TYPE": r"(?:i(?:\.i)*|p)(?:<TARGS>)?(?:\.i)*(?:S)*",
    "TERM": r"(?:[usk]|P|w|(?:i|P)G|[ip]S*r)*(?:i|l|P|B|<TYPE>B|pS*\.i|wi(?:\.i)*<TARGS>?PB?|TPB)(?:\.<TARGS>?[iw]|\.w|P|S|k|r[iw]|<TARGS>|B)*",
    "EX": r"<TERM>(?:[bsx<>=?:N]<TERM>)*",
    "ANN": r"@i(?:\.i)*P?",
    "LOCAL": r"(?:m|<ANN>)*<TYPE>q?i(?:S)*(?:=(?:<EX>|B))?(?:,i(?:S)*(?:=(?:<EX>|B))?)*",
    "ITEM": r"(?:<ANN>)*ai(?:\.i)*;|Mm?i(?:\.i)*(?:\.x)?;|;|<EX>;|<LOCAL>;|R<EX>?;|t<EX>;|Ji?;|IP|WP;?|LP|E|O|i:|C<EX>(?:,<EX>)*[:G]|d[:G]|Y P?B(?:cPB)*(?:yB)?|TPB|nPB|Z<EX>;|B|m"
    r"|(?:m|<ANN>)*Ki<TARGS>?P?(?:X<TYPE>(?:[,]<TYPE>)*)*B|(?:m|<ANN>)*<TARGS>?<TYPE>?iP(?:S)*(?:h<TYPE>(?:,<TYPE>)*)?(?:B|;|dl;|d<EX>;|dB;)|(?:m|<ANN>)*mB|<ANN>*iP?B?(?:,<ANN>*iP?B?)*,?;?|<EX>(?:,<EX>)*,?|zP?",
    "ROUND": r"(?:<EX>(?:,<EX>)*)?|(?:<LOCAL>(?:,<LOCAL>)*)|(?:<LOCAL>|<EX>)(?:,<EX>)*;<EX>?;(?:<EX>(?:,<EX>)*)?|;<EX>?;<EX>?|<LOCAL>:<EX>|(?:m)*<TYPE>(?:b<TYPE>)*i|<TYPE>(?:&<TYPE>)*|<LOCAL>(?:;<LOCAL>)*;?|i=<EX>(?:,i=<EX>)*|i=B",
    "SQUARE": r"<EX>?",
}
_JE = r"[ilpPSBGkusxb=<>?:.,qNw@mrX&T]"
_JAVA_KIND = r"(?:@i(?:\.i)*P?|m)*K[^;]*B;?"
_JAVA_PREFIX = r"(?:IP|WP|LP|E|O|i:|C[^;GIELWTR:]*[:G]|d[:G])*"
_JAVA_FORMS = {
    "P": rf"{_JE}*|{_JE}*;{_JE}*;{_JE}*|(?:{_JE}*;)*{_JE}*",
    "S": rf"{_JE}*",
    "top": rf"(?:@i(?:\.i)*P?)*a[i.]+;|Mm?[i.x]+;|{_JAVA_KIND}|;",
    "B": rf"{_JAVA_PREFIX}(?:;|{_JE}+;|R{_JE}*;|t{_JE}+;|Ji?;|B(?:E(?:IPB|B)?)*|YP?B(?:cPB)+(?:yB)?|YP?ByB|YPB|OBWP;|TPB|nPB|Z{_JE}+;|{_JAVA_KIND}|m?B|[^;B]*P S*B|{_JE}*PS*(?:h[i.,]+)?(?:B|;|d[^;]*;)|{_JE}+;?|{_JAVA_PREFIX})".replace("P S", "PS"),
}

# --- C ---------------------------------------------------------------------------------------------------------
# p type word, m qualifier or storage, K struct/union/enum, H typedef, a sizeof, g goto, x *
_C = {
    "TAIL": r"",
    "SPEC": r"(?:m|p|Ki?B?|i)+",
    "PTR": r"(?:xm*)*",
    "TERM": r"(?:[usxka]|P)*(?:i|l+|P|B|(?:m|p|Ki)+x*)(?:\.i|P|S|k)*",
    "EX": r"<TERM>(?:[bsx=?:]<TERM>)*",
    "INIT": r"<EX>|B",
    "DECL": r"H?<SPEC><PTR>(?:i|P)(?:P|S)*(?::<EX>)?(?:=<INIT>)?(?:,<PTR>(?:i|P)(?:P|S)*(?:=<INIT>)?)*",
    "ITEM": r";|<EX>(?:,<EX>)*;|<DECL>;|H?m*Ki?B?;|<SPEC><PTR>iPB|R<EX>?;|gi;|J;|IP|WP;?|LP|E|O|i:|C<EX>:|d:|TPB|B|(?:\.i=|S=|\.iS=)?(?:<INIT>)(?:,(?:\.i=|S=)?<INIT>)*,?|i(?:=<EX>)?(?:,i(?:=<EX>)?)*,?",
    "ROUND": r"(?:<EX>(?:,<EX>)*)?|(?:<SPEC><PTR>(?:i|P)?(?:S|P)*)(?:,(?:<SPEC><PTR>(?:i|P)?(?:S|P)*))*(?:,q)?|(?:<EX>(?:,<EX>)*|<DECL>)?;<EX>?;(?:<EX>(?:,<EX>)*)?|xm*i?S*",
    "SQUARE": r"m*<EX>?",
}
_CE = r"(?:[ilmpPSkusxb=?:.,aK]|(?<=[=,P])B)"
_C_PREFIX = r"(?:IP|WP|LP|E|O|i:|C[^;]*?:|d:)*"
_C_DECL = rf"(?:H?(?:m|p|Ki?B?)*i?[xm]*(?:i|P)(?:P|S)*(?::[il])?(?:=(?:B|{_CE}+))?(?:,[xm]*(?:i|P)(?:P|S)*(?:=(?:B|{_CE}+))?)*;)"
_C_TYPE = r"(?:m*(?:(?:m|p|Ki?B?)*(?:p|Ki?B?)(?:m|p)*|m*i|i)m*)"
_C_FORMS = {
    "P": rf"(?:[ilmpPSBkusxb=?:.,aqK]*)|[ilmpPSBkusxb=?:.,aqK]*;[ilmpPSBkusxb=?:.,aqK]*;[ilmpPSBkusxb=?:.,aqK]*",
    "S": r"[ilmpPSBkusxb=?:.,aqK]*",
    "top": rf";|H?m*K(?:iB?|B);|H?{_C_TYPE}[xm]*(?:i|P)(?:P|S)*(?:=(?:B|{_CE}+))?(?:,[xm]*(?:i|P)(?:P|S)*(?:=(?:B|{_CE}+))?)*;|m*{_C_TYPE}?[xm]*iP;?B|iP;",
    "B": rf"{_C_PREFIX}(?:;|[ilPSkusxb=?:.,aBmp]+;|H?{_C_TYPE}[xm]*(?:i|P)(?:P|S)*(?::[il])?(?:=(?:B|{_CE}+))?(?:,[xm]*(?:i|P)(?:P|S)*(?:=(?:B|{_CE}+))?)*;|H?m*Ki?B?;|R{_CE}*;|gi;|J;|B(?:E(?:IPB|B)?)*|OBWP;|TPB|[ilPSBkusxb=?:.,am]*)",
}

# --- Go --------------------------------------------------------------------------------------------------------
# F func, Y type, v var/const, M import, a package, g go/defer, K struct/interface, m map, h chan, n range, A <-, q ..., T switch/select
_GO = {
    "TAIL": r"",
    "TYPE": r"(?:[xuA]|S|h|hA|Ah|mS|q)*(?:i(?:\.i)?S?|P|KB|FP(?:i|P)?)",
    "SIG": r"P(?:<TYPE>|P)?",
    "TERM": r"(?:[usxA]|n)*(?:i|l|P|S<TYPE>B?|S<TYPE>P?|B|F<SIG>B|mS<TYPE>B?|h<TYPE>|KB B?|<TYPE>)(?:\.i|\.P|P|S|B)*".replace("B B", "BB"),
    "EX": r"<TERM>(?:[bsxA]<TERM>)*",
    "EXS": r"<EX>(?:,<EX>)*",
    "SIMPLE": r"<EXS>(?:[=]n?<EXS>|k|A<EX>)?",
    "VAR": r"i(?:,i)*<TYPE>?(?:=<EXS>)?",
    "ITEM": r";|<SIMPLE>;?|v(?:<VAR>|P);?|Y(?:iS?=?<TYPE>|P);?|M(?:[i.]?l|P);?|ai;?|FP?i<SIG>B?;?|R<EXS>?;?|Ji?;?|g<EX>;?|(?:[ILT](?:<SIMPLE>?;?)*)B|I<SIMPLE>;|L<SIMPLE>?;|<SIMPLE>?;<SIMPLE>?B|n<EX>B|L n<EX>B|LB|TB|E|B;?|C<EXS>(?:=<EX>)?:|C<EX>A<EX>:|C[^]:|d:|i:|(?:<EX>|B)(?::(?:<EX>|B))?(?:,(?:<EX>|B)(?::(?:<EX>|B))?)*,?|i(?:,i)*<TYPE>l?;?|x?i(?:\.i)?l?;?|i<SIG>;?|i=<EX>;?|<EX>B".replace("C[^]:|", "").replace("L n", "Ln"),
    "ROUND": r"(?:<EXS>q?,?)?|<TYPE>(?:,<TYPE>)*,?|Y|i(?:,i)*q?<TYPE>(?:,i(?:,i)*q?<TYPE>)*,?|(?:[i.]?l;)*(?:[i.]?l)?|(?:<VAR>;)*<VAR>?|(?:iS?=?<TYPE>;)*",
    "SQUARE": r"(?:<EX>|<EX>?:<EX>?(?::<EX>)?|q|<EXS>|i(?:,i)*<TYPE>)?",
}
_GE = r"[ilPSBFKmhAqkusxb=.,nY:]"
_GO_FORMS = {
    "P": r"[^RJLITECdaM]*", "S": rf"{_GE}*",
    "top": r"ai;?|M(?:[i.]?l|P);?|v(?:P|i[^;]*);?|Y(?:P|i[^;]+);?|FP?iS?P[^;]*;?|;",
    "B": rf"(?:E|i:|C[^;]*?:|d:)*(?:(?:[ILT]|E[I]?)?{_GE}*(?:B(?:EI{_GE}+|EB)*)?;?|I{_GE}+(?:EI{_GE}+)*(?:EB)?;?|R{_GE}*;?|Ji?;?|g{_GE}+;?|v(?:P|i{_GE}*);?|Yi{_GE}+;?|YP;?)",
}

# --- Python ----------------------------------------------------------------------------------------------------
# i name, l number or constant, " string, A async, F def, K class, I if, e elif, E else, L for, W while, T try, c except, y finally,
# w with, R return, t raise, M import, f from, s as, J pass/break/continue, g global/nonlocal, d del, a assert, z yield, j await,
# N in/is, n not, o and/or, Y lambda, H match/case, O type, x *, X **, p + and -, u ~, b binary, k :=, G ->, Z end of line
_PY = {
    "TERM": r"(?:[nupjxX]|Y:|Y<PARAMS>:)*(?:i|l|\"+|P|S|B|z)(?:\.i|P|S)*",
    "PARAMS": r"(?:[xX]*i(?:=<TERM>)?|b|x)(?:,(?:[xX]*i(?:=<TERM>)?|b|x))*,?",
    "EX": r"<TERM>(?:(?:[bpxXoNk]|nN|Nn|I|E)<TERM>)*",
    "FORIN": r"(?:A?L<EX>(?:,<EX>)*,?N<EX>(?:I<EX>)*)+",
    "EXS": r"<EX>(?:,<EX>)*,?",
    "YIELD": r"z(?:f<EX>|<EXS>)?",
    "NAME": r"i(?:\.i)*",
    "SMALL": r"<EXS>(?:=(?:<EXS>|<YIELD>))*|<EX>:<EX>(?:=(?:<EXS>|<YIELD>))?|<YIELD>|R<EXS>?|t(?:<EX>(?:f<EX>)?)?|M<NAME>(?:si)?(?:,<NAME>(?:si)?)*|f(?:\.+<NAME>?|<NAME>)M(?:x|P|i(?:si)?(?:,i(?:si)?)*)|J|gi(?:,i)*|d<EXS>|a<EX>(?:,<EX>)?|OiS?=<EX>",
    "SUITE": r"(?:ZD|<SMALL>(?:;<SMALL>)*;?Z)",
    "ITEM": r"<SMALL>(?:;<SMALL>)*;?Z|Z|(?:I|e|W)<EX>:<SUITE>|(?:E|T|y):<SUITE>|A?L<EXS>N<EXS>:<SUITE>|A?w<EX>(?:s<EX>)?(?:,<EX>(?:s<EX>)?)*:<SUITE>|cx?(?:<EXS>(?:si)?)?:<SUITE>|A?FiS?P(?:G<EX>)?:<SUITE>|KiS?P?:<SUITE>|@<EX>Z|H<EXS>(?:s<EX>)?(?:I<EX>)?:<SUITE>",
    "ROUND": r"(?:<EX>(?:,<EX>)*,?)?|<YIELD>|<EX><FORIN>|(?:[xX]*i(?::x?<EX>)?(?:=<EX>)?|b|x)(?:,(?:[xX]*i(?::x?<EX>)?(?:=<EX>)?|b|x))*,?|i(?:si)?(?:,i(?:si)?)*,?|<EX>(?:s<EX>)?(?:,<EX>(?:s<EX>)?)*,?|(?:<EX>,)*i=<EX>(?:,i=<EX>)*",
    "SLICE": r"<EX>?:<EX>?(?::<EX>?)?|<EX>",
    "SQUARE": r"(?:<SLICE>(?:,<SLICE>)*,?)?|<EX><FORIN>",
    "CURLY": r"(?:(?:<EX>(?::<EX>)?|X<EX>)(?:,(?:<EX>(?::<EX>)?|X<EX>))*,?)?|<EX>(?::<EX>)?<FORIN>",
}
_PE = r"[il\"PSBzjnupxXobNkYIE.,=:]"
_PS = rf"(?:(?![IEN:.,=Yk]){_PE}+(?<![:.=])|Y{_PE}+(?<![:.=])|R{_PE}*|t(?:{_PE}+(?:f{_PE}+)?)?|M[i.,s]+|f[.i]+M(?:x|P|[i,s]+)|J|g[i,]+|d{_PE}+|a{_PE}+|z(?:f?{_PE}+)?|{_PE}+=zf?{_PE}*|OiS?={_PE}+)"
_SUITE = rf"(?:ZD|{_PS}(?:;{_PS})*;?Z)"
_PY_FORMS = {
    "P": r"[^;ZD]*", "S": r"[^;ZD]*", "B": r"[^;ZD]*",
    "D": rf"{_PS}(?:;{_PS})*;?Z|Z|[IeW]{_PE}+:{_SUITE}|[ETy]:{_SUITE}|A?L{_PE}+:{_SUITE}|A?w[il\"PSBjnupxXobNk.,s=]+:{_SUITE}|cx?[il\"PSB.,s]*:{_SUITE}|A?FiS?P(?:G{_PE}+)?:{_SUITE}|KiS?P?:{_SUITE}|@{_PE}+Z|H[^:Z]*:{_SUITE}",
}


_BRACKETS = {"P": "<ROUND>", "S": "<SQUARE>", "B": "(?:<ITEM>)*<TAIL>?", "top": "(?:<ITEM>)*<TAIL>?"}


@functools.lru_cache(maxsize=1)
def languages() -> dict[str, dict]:
    """For each language its permissible ``pairs`` and the ``forms`` of its levels."""
    c_like = {
        "javascript": (_JS, _JS_FORMS | {"top": _JS_FORMS["B"]}), "typescript": (_TS, _TS_FORMS | {"top": _TS_FORMS["B"]}),
        "java": (_JAVA, _JAVA_FORMS), "c": (_C, _C_FORMS), "go": (_GO, _GO_FORMS),
    }
    out = {name: {"pairs": permissible_pairs(rules, _BRACKETS), "forms": forms} for name, (rules, forms) in c_like.items()}
    python = {"P": "<ROUND>", "S": "<SQUARE>", "B": "<CURLY>", "D": "(?:<ITEM>)+", "top": "(?:<ITEM>)*"}
    out["python"] = {"pairs": permissible_pairs(_PY, python), "forms": _PY_FORMS | {"top": _PY_FORMS["D"]}}
    return out
