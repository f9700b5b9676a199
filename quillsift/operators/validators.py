"""Whether a candidate is a value of its kind: a table of tests for each kind.

A candidate knows its value as shown, its shape (A for capital letters, a for others, 9 for digits, signs as they
are) and the places where it stands in a text.  Every kind is a row of tests that must all hold; other
tables say which kind a value really is, and what goes into the dictionary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

# fixed values: the patterns of sensitive values
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)\bhttps?://[^\s)]+"
KEYS = ("EMAIL", "PHONE", "URL", "ACCOUNT", "PERSON", "ADDRESS", "CUSTOM")
# fixed values: words that name a field and aren't its value
GENERIC = {
    "n/a", "na", "none", "null", "unknown", "unspecified", "redacted", "placeholder", "value", "field", "form", "entry", "text", "data", "name", "full name", "first name", "last name", "middle name",
    "surname", "given name", "company name", "account", "account number", "routing number", "card number", "phone", "phone number", "mobile", "email", "email address", "address", "street", "city", "state",
    "zip", "zip code", "postal code", "country", "signature", "dob", "date of birth",
}
# fixed values: words that a person's name doesn't have
PERSON_WORDS = {"name", "first", "last", "middle", "full", "surname", "given", "applicant", "insured", "beneficiary", "patient", "signature", "person", "people", "individual", "individuals"}
# fixed values: words that are no identifier
CUSTOM_WORDS = {
    "username", "user", "userid", "user_id", "user-id", "handle", "nickname", "forumid", "forum_id", "forum-id", "customid", "custom_id", "custom-id", "employee", "employeeid", "employee_id",
    "employee-id", "speaker", "contact", "participant",
}
# fixed values: words of addresses
ADDRESS_WORDS = {
    "street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "boulevard", "blvd", "court", "ct", "circle", "cir", "highway", "hwy", "parkway", "pkwy", "suite", "ste", "unit", "apt",
    "apartment", "box", "po",
}
# fixed values: regions
REGIONS = {
    "al", "ak", "az", "ar", "ca", "co", "ct", "dc", "de", "fl", "ga", "hi", "ia", "id", "il", "in", "ks", "ky", "la", "ma", "md", "me", "mi", "mn", "mo", "ms", "mt", "nc", "nd", "ne", "nh", "nj", "nm",
    "nv", "ny", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "va", "vt", "wa", "wi", "wv", "wy",
}
# fixed values: roles that numbered participants have
ROLES = ["agent", "student", "customer", "applicant", "presenter", "learner", "participant", "representative", "user", "employee", "member", "client", "patient"]
# fixed values: labels of fields that a value may follow
LABELS = {
    "PERSON": r"first\s*name|last\s*name|full\s*name|given\s*name|middle\s*name|family\s*name|surname|lastname|firstname|fullname|givenname|middlename|familyname",
    "ADDRESS": r"country|building(?:\s+number)?|street|city|state|postcode|postal\s*code|zip|address",
    "OTHER": r"email|e-mail|phone(?:\s+number)?|telephone(?:\s+number)?|contact\s+number|mobile|fax|url|website",
    "ACCOUNT": r"account(?:\s+(?:number|no|num))?|acct(?:\s+(?:number|no|num))?|iban|routing(?:\s+number)?|card(?:\s+number)?|ssn|social\s+security(?:\s+number)?|passport(?:\s+number)?|id\s+number|id\s+card|student\s+id|application\s+id|identifier|tax\s*id|tin",
}
# fixed values: words that open an enumeration of names
LISTS = r"such\s+as|including|include|comprising(?:\s+of)?|consisting\s+of|comprised\s+of|team\s+member|expert\s+veterinarian|veterinarians|members?"
# fixed values: prefixes of account values
ACCOUNT_PREFIX = r"(?i)(?:acct|account|iban|routing|card|ssn|passport|idcard|social|taxid|tax-id|tin)[\s:_#-]*[A-Z0-9]"
# fixed values: pairs of quotes and brackets around a value
AROUND = {'"': '"', "'": "'", "`": "`", "[": "]", "{": "}", "(": ")"}
# fixed values: the least lengths and counts of the tests, and how far around a name its list is looked for
LEAST_VALUE, LEAST_NAME, LEAST_ADDRESS, NEAR = 3, 5, 8, 96
ACCOUNT_DIGITS, ACCOUNT_SIGNS, ACCOUNT_SOME, PHONE_DIGITS = 6, 8, 4, range(11, 16)

SHAPE = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}})
#: Shapes of handles: after an at sign; with digits, and signs or capitals if it is short; parts joined by signs; mixed case.
HANDLES = (
    r"@(?=.*[Aa])[Aa9._-]{3,}",
    r"(?!@)(?=.*[Aa])(?=.*9)(?:[Aa9._-]{5,}|(?=9|.*[A._-])[Aa9._-]{4})",
    r"(?!@)(?=(?:[@._-]*[Aa]){4})[@._-]*[Aa]+(?:[@._-]+[Aa]+)+[@._-]*",
    r"(?=.*(?:aA|AA))[Aa]{4,}",
)
#: Ordinary words with hyphens between.
HYPHENED = r"-*Aa+(?:-+Aa+)+-*"
SIGNS = r"[\s:=#\-\"'\[\]()<>/]"
ANY_LABEL = "|".join(LABELS.values())


def bare(value: str | None) -> str:
    """A value without the space and the pairs of signs around it."""
    v = " ".join((value or "").split())
    while len(v) > 1 and AROUND.get(v[0]) == v[-1] and v[1:-1].strip():
        v = v[1:-1].strip()
    return v


def digits_of(v: str) -> str:
    return re.sub(r"\D", "", v)


def normal(key: str, value: str) -> str:
    """The form in which two values of a kind are the same."""
    forms = {
        "PHONE": lambda v: re.sub(r"^1(?=\d{10}$)", "", digits_of(v)),
        "URL": lambda v: v.lower().rstrip("/"), "EMAIL": lambda v: v.lower().rstrip("/"),
    }
    return forms.get(key, lambda v: " ".join(v.split()).lower())((value or "").strip())


@dataclass(frozen=True)
class Candidate:
    key: str
    value: str | None
    text: str | None = None

    def __hash__(self):
        return id(self)

    def of(self, key: str) -> Candidate:
        return Candidate(key, self.value, self.text)

    @cached_property
    def shown(self) -> str:
        return bare(self.value)

    @cached_property
    def low(self) -> str:
        return self.shown.lower()

    @cached_property
    def core(self) -> str:
        return self.low.strip(" .,:;")

    @cached_property
    def digits(self) -> str:
        return digits_of(self.shown)

    @cached_property
    def shape(self) -> str:
        return self.shown.translate(SHAPE)

    @cached_property
    def words(self) -> set[str]:
        return set(re.findall("[a-z0-9#]+", self.low))

    def places(self):
        """(line up to the value, whole line, what is near) of each place in the text."""
        text = self.text or ""
        for m in re.finditer(re.escape(self.shown), text, flags=re.I):
            line = re.compile(r".*").match(text, text.rfind("\n", 0, m.start()) + 1).group()
            yield line[: m.start() - text.rfind("\n", 0, m.start()) - 1], line, text[max(0, m.start() - NEAR) : m.end() + NEAR]

    def labelled(self, kind: str) -> bool:
        """Somewhere a label of this kind stands before the value, with signs and attribute names of no label between."""
        gap = rf"(?:{SIGNS}|\b(?!(?:{ANY_LABEL})\s*=)[A-Za-z_][A-Za-z0-9_:-]*\s*=)*"
        return any(re.search(rf"(?i)(?>{LABELS[kind]}){gap}$", re.sub("<[^>]+>", "", before)) for before, _, _ in self.places())


# ---------------------------------------------------------------- tests


def role(c: Candidate) -> bool:
    """customer12, Agent B and the like."""
    return bool(re.fullmatch(rf"(?i:{'|'.join(ROLES)})(?:\d{{1,3}}| (?:[A-Z]\d{{0,3}}|\d{{1,3}}[A-Z]?))", c.shown))


def named(c: Candidate) -> bool:
    return bool(c.core) and c.core not in GENERIC and bool(c.low.strip(" .,:;").strip("_.- "))


def unmasked(c: Candidate) -> bool:
    return not re.fullmatch("[Xx*#._-]+", c.shown)


def long_enough(c: Candidate) -> bool:
    return len(c.shown) >= LEAST_VALUE or c.key == "ADDRESS" and c.labelled("ADDRESS")


def present(c: Candidate) -> bool:
    """In the text, if there is one: numbers by their digits, addresses of the net by their normal form."""
    if c.text is None:
        return True
    if c.key in ("PHONE", "ACCOUNT") and c.digits:
        return c.digits in digits_of(c.text)
    form = (lambda v: normal(c.key, v)) if c.key in ("EMAIL", "URL") else str.lower
    return form(c.shown) in form(c.text)


def telephone(c: Candidate) -> bool:
    return bool(re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", d := normal("PHONE", c.shown))) or len(d) in PHONE_DIGITS


def account(c: Candidate) -> bool:
    signs = len(re.sub(r"[\s-]", "", c.shown))
    return len(c.digits) >= ACCOUNT_DIGITS or signs >= ACCOUNT_SIGNS and len(c.digits) >= ACCOUNT_SOME


def name_words(c: Candidate) -> list[str]:
    """The words of a value that can be a person's name."""
    found = re.findall(r"[A-Za-z][A-Za-z'’-]*", c.shown)
    fits = not re.search(r"[\d:@/]", c.shown) and c.low not in GENERIC and not role(c) and PERSON_WORDS.isdisjoint(t.lower() for t in found)
    return found if fits and sum(map(len, found)) >= LEAST_NAME else []


def in_row(c: Candidate) -> bool:
    """One of several quoted or comma-separated fields of a line."""
    for _, line, _ in c.places():
        quoted = [q.strip().lower() for q in re.findall(r'"([^"\n]{1,64})"', line)]
        cells = [x.strip().strip('"').lower() for x in re.split("[,\t]", line)] if line.count(",") >= 4 else []
        if c.low in cells or len(quoted) >= 3 and c.low in quoted:
            return True
    return False


def in_list(c: Candidate) -> bool:
    """Among other names: in brackets, after words that open a list, or between quotes and commas."""
    for *_, near in c.places():
        n = {sign: near.count(sign) for sign in '[]",('}
        names = len({t.lower() for t in re.findall(r"[A-Z][A-Za-z'’-]{2,}", near)})
        signs = ((2, n["["] >= 2 and n["]"] >= 2), (2, n[","] >= 2 and (n['"'] >= 4 or n["("] > 0) and re.search(f"(?i)(?:{LISTS})", near)), (3, n['"'] >= 4 and n[","] >= 4))
        if any(names >= least and holds for least, holds in signs):
            return True
    return False


def person(c: Candidate) -> bool:
    """More than one word, or one that stands where names do."""
    found = name_words(c)
    return len(found) > 1 or bool(found) and (c.labelled("PERSON") or in_row(c) or in_list(c))


def address(c: Candidate) -> bool:
    """With a digit or a word of addresses; short ones, codes of regions and other words only after a label."""
    short = len(c.shown) < LEAST_ADDRESS or c.core in REGIONS or bool(re.fullmatch("[Aa]{2,3}", c.shape))
    if c.core in GENERIC or short and not c.labelled("ADDRESS"):
        return False
    if c.core in REGIONS or re.fullmatch("[Aa]{2,3}", c.shape):
        return True
    return "9" in c.shape or not c.words.isdisjoint(ADDRESS_WORDS) or any(x.isalpha() for x in c.shown) and c.labelled("ADDRESS")


def handle(c: Candidate) -> bool:
    known = " " in c.shown or c.low in GENERIC | CUSTOM_WORDS or role(c)
    return not known and not re.fullmatch(HYPHENED, c.shape) and any(re.fullmatch(p, c.shape) for p in HANDLES)


def place(c: Candidate) -> bool:
    """An address that is more than a region, a number or one word: with a word of addresses, or parts after commas."""
    single = c.core in REGIONS or re.fullmatch(r"\d+[A-Za-z0-9-]*|[A-Za-z][A-Za-z'’-]+", c.shown)
    return not single and (not c.words.isdisjoint(ADDRESS_WORDS) or "," in c.shown and len(c.words) > 1)


def own_account(c: Candidate) -> bool:
    """An account value by itself: digits alone, after a prefix, or a code of capitals that is long enough."""
    v = "".join(c.shown.split())
    code = len(v) >= ACCOUNT_SIGNS and not re.search("[._@a-z]", v)
    return len(digits_of(v)) >= ACCOUNT_DIGITS and allowed("ACCOUNT", v) and (code or not any(x.isalpha() for x in v) or bool(re.match(ACCOUNT_PREFIX, v)))


# ---------------------------------------------------------------- tables

ALWAYS = (named, unmasked, long_enough, present)
TESTS = {
    "EMAIL": lambda c: bool(re.fullmatch(EMAIL, c.shown)),
    "URL": lambda c: bool(re.fullmatch(URL, c.shown)),
    "PHONE": telephone,
    "ACCOUNT": account,
    "PERSON": person,
    "ADDRESS": address,
    "CUSTOM": handle,
}
#: What a candidate is instead: kinds it was taken for (none: any), the kind, the test; the first that holds.
INSTEAD = (
    ((), "ACCOUNT", lambda c: c.labelled("ACCOUNT") and holds(c.of("ACCOUNT"))),
    (("PERSON",), "CUSTOM", handle),
    (("CUSTOM",), "EMAIL", lambda c: holds(c.of("EMAIL"))),
    (("CUSTOM",), "PHONE", lambda c: holds(c.of("PHONE"))),
    (("CUSTOM",), "URL", lambda c: holds(c.of("URL"))),
    (("CUSTOM",), "ACCOUNT", own_account),
)


def holds(c: Candidate) -> bool:
    return c.key in TESTS and bool(c.shown) and all(test(c) for test in ALWAYS) and TESTS[c.key](c)


def allowed(key: str, value: str | None, text: str | None = None) -> bool:
    """Whether a candidate is a value of its kind; with ``text``, whether it stands there in a fitting place."""
    return holds(Candidate(key, value, text))


def persistent(key: str, value: str | None, text: str | None = None) -> bool:
    """The stricter test for values that go into the dictionary; a person's single name may."""
    c = Candidate(key, value, text)
    if key == "PERSON":
        return bool(name_words(c))
    return holds(c) and (key != "ADDRESS" or place(c))


def remap(key: str, value: str, text: str | None = None) -> str:
    """The kind that a candidate's place or form shows it to be."""
    c = Candidate(key, value, text)
    return next((kind for kinds, kind, test in INSTEAD if c.shown and (not kinds or key in kinds) and test(c)), key)


def expand_address(value: str, text: str) -> list[str]:
    """An address that stands in the text; else those of its parts that do: split at commas, and number or code from words."""
    whole = bare(value)
    pieces = [p.strip() for p in whole.split(",") if p.strip()]
    split = [m.groups() if (m := re.fullmatch(r"(\d[\w-]*)\s+(.+)|(.+?)\s+(\d[\w-]*)", p)) else () for p in pieces]
    parts = [x for p, xs in zip(pieces, split) for x in (p, *xs) if x]
    within = lambda p: p.lower() in text.lower()
    return [whole] if whole and within(whole) else [p for p in dict.fromkeys(parts) if within(p)]
