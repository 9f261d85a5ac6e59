"""All look-alikes of a name, against a plain loop over tables written apart from the code."""

import re

import pytest

from sparkveil.operators import generators

KEYS = "1:2q 2:1qw3 3:2we4 4:3er5 5:4rt6 6:5ty7 7:6yu8 8:7ui9 9:8io0 0:9op q:12wa w:3qeasd2 e:4wrsdf3 r:5etdfg4 t:6ryfgh5 y:7tughj6 u:8yihjk7 i:9uojkl8 o:0ipkl9 p:lo0 a:qwsz s:edxzaw d:rfcxse f:tgvcdr g:yhbvft h:ujnbgy j:ikmnhu k:olmji l:kop z:asx x:zsdc c:xdfv v:cfgb b:vghn n:bhjm m:njk"
GLYPHS = "0:o 1:l,i 2:z 5:s 6:b 8:b 9:g,q b:d,lb,6 c:e d:b,cl,dl e:c g:q,9 h:lh i:1,l l:1,i m:n,nn,rn n:m,r o:0 q:g,9 s:5 u:v v:u w:vv z:2"
SUFFIXES = "com net org info biz co io app dev xyz online site shop store us uk eu de cn ru top live cc me"


def squats(name, suffix):
    keys = dict(x.split(":") for x in KEYS.split())
    glyphs = {k: v.split(",") for k, v in (x.split(":") for x in GLYPHS.split())}
    n, out = len(name), {}
    cut = lambda i, new, skip=1: name[:i] + new + name[i + skip :]
    made = [("tld-swap", name, t) for t in SUFFIXES.split()] + [("addition", name + chr(c), suffix) for c in range(97, 123)] + [("omission", cut(i, ""), suffix) for i in range(n)]
    made += [("transposition", cut(i, name[i + 1] + name[i], 2), suffix) for i in range(n - 1)] + [("repetition", cut(i, c + c), suffix) for i, c in enumerate(name)]
    made += [("replacement", cut(i, k), suffix) for i, c in enumerate(name) for k in keys.get(c, "")] + [("insertion", cut(i, k + c), suffix) for i, c in enumerate(name) for k in keys.get(c, "")]
    made += [("homoglyph", cut(i, k), suffix) for i, c in enumerate(name) for k in glyphs.get(c, ())]
    made += [("bitsquatting", cut(i, f), suffix) for i, c in enumerate(name) for b in range(8) if re.fullmatch("[a-z0-9-]", f := chr(ord(c) ^ 1 << b))]
    made += [(f, cut(i, s, 0), suffix) for f, s in (("hyphenation", "-"), ("subdomain", ".")) for i in range(1, n)] + [("vowel-swap", cut(i, v), suffix) for i, c in enumerate(name) if c in "aeiou" for v in "aeiou"]
    for fuzzer, label, tld in made:
        if f"{label}.{tld}" != f"{name}.{suffix}" and all(re.fullmatch("[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", x) for x in label.split(".")):
            out.setdefault(f"{label}.{tld}", fuzzer)
    return out


@pytest.mark.parametrize("domain", ["modern-9g.co.uk", "wiki.com", "x.org"])
def test_all_fuzzers(spark, domain):
    got = generators.typosquats(spark.createDataFrame([(domain,)], "domain string")).collect()
    assert {r.candidate: r.fuzzer for r in got} == squats(*domain.split(".", 1)) and len(got) == len({r.candidate for r in got})
