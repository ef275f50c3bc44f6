"""Plain Python versions of the queries' contracts."""

import hashlib
import re
import zlib

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingle_sets(docs):
    out = {}
    for i, t in docs.items():
        w = WS.findall((t or "").translate(LOW))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def groups(docs):
    sets = shingle_sets(docs)
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def leaks(docs, bench):
    items = []
    for item, t in bench:
        w = ALNUM.findall((t or "").translate(LOW))
        if w:
            n = min(10, len(w))
            items += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    out = {}
    for i, t in docs.items():
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for item, g in items:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def passages(docs, size=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = True
            else:
                seen.add(b[p : p + size])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_words(w, size=8):
    at = {}
    for k in range(len(w) - size + 1):
        at.setdefault(tuple(w[k : k + size]), []).append(k)
    return len({j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + size)})


def longest_repeat(w):
    """Words of the longest substring that occurs twice."""
    lo, hi = 0, len(w)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        at = [tuple(w[k : k + mid]) for k in range(len(w) - mid + 1)]
        lo, hi = (mid, hi) if len(set(at)) < len(at) else (lo, mid - 1)
    return lo


def quality(docs):
    out = {}
    for i, t in docs.items():
        t = t or ""
        w = WS.findall(t)
        lines = [x for x in t.split("\n") if WS.search(x)]
        n, rep, long = len(w), repeat_words(w), longest_repeat(w)
        failed = n < 20 or 100 * rep > 30 * n
        long = long if long >= 8 else 0
        bad = long > 50 and long > 0.2 * n
        out[i] = (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, failed, not failed and not bad)
    return out


def chats(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for c, own in convs.items():
        own.sort()
        turns = "".join(f"{r}\n{t}\n" for _, r, _, t in own)
        loss = "".join(t for _, r, _, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def lcs(a, b):
    """Words of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


# ---- pseudonyms, a match at a time ----


def _noise(key, tweak, i, half):
    return int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)


def _feistel(a, b, mod_a, mod_b, key, tweak):
    for i in range(10):
        a, b = b, (a + _noise(key, tweak, i, b)) % (mod_a if i % 2 == 0 else mod_b)
    return a, b


def permuted(x, size, key, tweak):
    low = 10 ** ((len(str(size - 1)) + 1) // 2)
    high = -(-size // low)
    while True:
        a, b = _feistel(x // low, x % low, high, low, key, tweak)
        x = a * low + b
        if x < size:
            return x


def digits_permuted(d, key, tweak):
    u = len(d) // 2
    v = len(d) - u
    a, b = _feistel(int(d[:u] or 0), int(d[u:]), 10**u, 10**v, key, f"{tweak}{len(d)}")
    return (str(a).zfill(u) if u else "") + str(b).zfill(v)


def letters_permuted(s, key, tweak):
    u = len(s) // 2
    v = len(s) - u
    value = lambda x: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(x)))
    show = lambda x, n: "".join(chr(97 + x // 26**i % 26) for i in range(n - 1, -1, -1))
    a, b = _feistel(value(s[:u]), value(s[u:]), 26**u, 26**v, key, f"mail{len(s)}{tweak}")
    return show(a, u) + show(b, v)


def other_permuted(c, key, tweak):
    import regex

    fits = lambda x: bool(regex.fullmatch(r"[\p{L}\p{N}]", x)) and x.lower() == x
    if not fits(c):
        return c
    base, v = ord(c) // 128 * 128, ord(c) % 128
    while True:
        v = permuted(v, 128, key, f"letter{base}|{tweak}")
        if fits(chr(base + v)):
            return chr(base + v)


def _pieces(s, most, f):
    done = ""
    for i in range(0, len(s), most):
        done += f(s[i : i + most], done)
    return done


def _put(m, *kinds):
    """m with the characters of each (test, new characters) replaced in order."""
    new = [(test, iter(x)) for test, x in kinds]
    return "".join(next((next(it) for test, it in new if test(c)), c) for c in m)


def _is_digit(c):
    return "0" <= c <= "9"


def _luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(d)))


def _one_number(m, key):
    import datetime as dt

    from cloakframe.llm import pii

    full = lambda p: re.fullmatch(p, m)
    d = "".join(filter(_is_digit, m))
    if full(pii.IBAN):
        value = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        plain = m.replace(" ", "")
        body = plain[4:]
        own = "".join(filter(_is_digit, body))
        if not own or value(body + plain[:4]) != 1:
            return m, ""
        new = _put(body, (_is_digit, digits_permuted(own, key, "iban")))
        made = plain[:2] + str(98 - value(new + plain[:2] + "00")).zfill(2) + new
        return _put(m, (lambda c: c != " ", made)), "iban"
    if full(pii.DATE):
        iso, slash = m[4] == "-", "/" in m
        y, mo, day = (m[:4], m[5:7], m[8:]) if iso else (m[6:], m[3:5], m[:2])
        first = slash and int(mo) > 12
        if first:
            mo, day = day, mo
        try:
            at = dt.date(int(y), int(mo), int(day))
        except ValueError:
            return m, ""
        if not 1900 <= at.year <= 2099:
            return m, ""
        zero = dt.date(1900, 1, 1)
        n = (at - zero).days
        while True:
            n = permuted(n, 73049, key, "date")
            new = zero + dt.timedelta(n)
            if (new.day > 12) == (at.day > 12):
                break
        return new.strftime("%Y-%m-%d" if iso else "%m/%d/%Y" if first else "%d/%m/%Y" if slash else "%d.%m.%Y"), "date"
    if full(pii.IP):
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return m, ""
        x = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
        return ".".join(map(str, x.to_bytes(4, "big"))), "ip"
    if full(pii.SSN):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return m, ""
        x = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
        area = x // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}", "ssn"
    if full(pii.CARD):
        if _luhn(d) % 10 or not d.strip("0"):
            return m, ""
        new = digits_permuted(d[:-1], key, "card")
        return _put(m, (_is_digit, new + str(-_luhn(new + "0") % 10))), "card"
    plan = full(r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}")
    own = d[-10:]
    if plan:
        north = int(own[:3]) >= 200 and int(own[3:6]) >= 200
        if not north and m[0] != "+":
            return m, ""
        if north:
            x = permuted(((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10000 + int(own[6:]), 6_400_000_000, key, "phone")
            new = f"{x // 8_000_000 + 200:03d}{x // 10000 % 800 + 200:03d}{x % 10000:04d}"
        else:
            new = digits_permuted(own, key, "phone1")
        return _put(m, (_is_digit, d[:-10] + new)), "phone"
    if not 7 <= len(d) <= 15:
        return m, ""
    return _put(m, (_is_digit, d[:2] + digits_permuted(d[2:], key, "phone2"))), "phone"


def pseudonyms(text, key):
    """The text with pseudonyms, and the kinds replaced."""
    import regex

    from cloakframe.llm import pii

    kinds, numbers = [], []

    def mail(m):
        given, rest = m[0].split("@", 1)
        local = given.lower()
        low = lambda c: "a" <= c <= "z"
        other = lambda c: not low(c) and not _is_digit(c) and bool(regex.fullmatch(r"[\p{L}\p{N}]", c))
        letters = _pieces("".join(filter(low, local)), 22, lambda x, done: letters_permuted(x, key, done))
        digits = _pieces("".join(filter(_is_digit, local)), 30, lambda x, done: digits_permuted(x, key, "mail" + done))
        others = _pieces("".join(filter(other, local)), 1, lambda x, done: other_permuted(x, key, f"{done}|{letters}"))
        kinds.append("email")
        return _put(local, (low, letters), (_is_digit, digits), (other, others)) + "@" + rest

    def number(m):
        new, kind = _one_number(m[0], key)
        numbers.extend([kind] * bool(kind))
        return new

    if text is None:
        return None, []
    out = regex.sub(pii.NUMBERS, number, regex.sub(pii.EMAIL, mail, text))
    return out, kinds + numbers
