"""Fixed values and defaults."""

# Top-level domains that are crawled.
ALLOWED_TLDS = [
    "bbs", "chan", "cyb", "dyn", "epic", "geek", "gopher", "indy", "libre", "neo", "null", "o", "oss", "oz", "parody",
    "pirate", "free", "bazar", "coin", "emc", "lib", "fur", "ku", "te", "ti", "uu", "ko", "rm",
]

# URL patterns that are not crawled (after the scheme, anchored at the start).
DENIED_URLS = [r"grep\.geek/\?.*(s=DRP|su=title|cc=1).*"]



def _attribute(name: str, value: str) -> str:
    """An attribute in a tag; in ``value``, ``@`` stands for any character that the quotes allow."""
    quoted = [f"{q}{value.replace('@', f'[^{q}]')}{q}" for q in "\"'"]
    bare = value.replace("@", r"""[^\s"'>]""")
    return rf"""(?is)\s{name}\s*=\s*(?:{quoted[0]}|{quoted[1]}|{bare}(?=[\s>]))"""


def _id(value: str) -> str:
    return _attribute("id", value)


def _class(value: str) -> str:
    """One of the element's classes."""
    return _attribute("class", rf"(?:@*\s)?{value}(?:\s@*)?")


# Page templates that are not indexed: name, elements, and whether the site's root page may stay. Each element is ``in`` the
# one before it (at any depth), or the ``next`` one after its end, and has all the attributes. Elements and attributes are fixed values.
TEMPLATE_RULES = [
    ("reddit frontend", [("in", "span", [_id("lib")]), ("next", "span", [_id("reddit")])], True),
    ("apache manual", [("in", "div", [_id("page-header")]), ("in", "p", [_class("apache")])], False),
    ("apache default page", [("in", "div", [_attribute("class", "@*_page")]), ("in", "div", [_class("page_header"), _class("floating_element")]),
                             ("in", "img", [_class("floating_element")])], False),
    ("cgit", [("in", "div", [_id("cgit")]), ("in", "table", [_id("header")]), ("in", "tbody", []), ("in", "tr", []), ("in", "td", [_class("logo")]),
              ("in", "a", []), ("in", "img", [])], True),
    ("gitea", [("in", "footer", []), ("in", "div", [_class("ui"), _class("container")]), ("in", "div", [_class("ui"), _class("left")]),
               ("in", "a", [_attribute("href", "@*gitea@*")])], True),
]

# Content types that are indexed, and the type of a URL without a known extension.
ALLOWED_MIMETYPES = ["text/html", "text/xml", "text/plain"]
DEFAULT_MIMETYPE = "text/html"

DEPTH_LIMIT = 5
RECRAWL_WAIT_S = 7 * 24 * 3600
BANDWIDTH_LIMIT = 175 * 1000**3
BANDWIDTH_INTERVAL_S = 7 * 24 * 3600
ROBOTS_MAX_AGE_S = 7200
RATE_LIMIT_S = 3600
