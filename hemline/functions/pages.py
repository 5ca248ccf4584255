"""Product fields from the HTML of a page, as native expressions.

A page is cut into tags and texts once; an element is the run of pieces from
its opening tag to the closing tag at the same depth of its own tag name.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.functions.common import ColumnLike, col, let, strip

# Markup that carries no visible text, and the pieces of the rest.
HIDDEN_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# A tag may hold ">" inside quotes; one whose quotes do not close ends at the first ">".
PIECE = r"""<[/!?a-zA-Z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|<[/!?a-zA-Z][^>]*>|[^<]+|<"""
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")

# Every named character reference of the HTML standard, in one constant text that Spark turns into a map once.
_PAIR, _ENTRY = "\x01", "\x02"
REFERENCES = _ENTRY.join(f"{name}{_PAIR}{symbol}" for name, symbol in html5.items())
NO_CHARACTER = "�"


def has_attribute(name: str, value: str, tag: str = "") -> str:
    """Pattern of an opening tag whose attribute equals ``value``."""
    return _opening(tag, rf"""\s{name}\s*=\s*(?:"{value}"|'{value}'|{value}(?=[\s>]))""")


def attribute_contains(name: str, part: str, tag: str = "") -> str:
    """Pattern of an opening tag whose attribute contains ``part``."""
    return _opening(tag, rf"""\s{name}\s*=\s*(?:"[^"]*{part}|'[^']*{part}|[^\s"'>]*{part})""")


def has_class(name: str, tag: str = "") -> str:
    """Pattern of an opening tag that lists ``name`` among its classes."""
    return _opening(tag, rf"""\sclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))""")


def any_tag(tag: str) -> str:
    return _opening(tag, "")


def _opening(tag: str, attribute: str) -> str:
    """A piece is one whole tag, so the pattern need not look for its end."""
    name = rf"(?i:{tag})" if tag else "[a-zA-Z][a-zA-Z0-9]*"
    return rf"^<{name}(?s:.*?){attribute}" if attribute else rf"^<{name}[\s>]"


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for 0, a surrogate, and what lies beyond the last."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(NO_CHARACTER))


def decode_references(text: ColumnLike) -> Column:
    """Replace numeric and named character references, each once, from left to right.

    Names are those of the HTML standard, with their semicolon, or without it
    where the standard knows them so.  What is no reference stays as it is.
    """
    text = col(text)

    def one(tail: Column) -> Column:
        """The text after an ampersand, with the reference it begins with replaced."""
        number = F.regexp_extract(tail, r"^#([0-9]+|[xX][0-9a-fA-F]+)", 1)
        digits = F.ltrim(F.regexp_replace(number, "^[xX]", ""), F.lit("0"))
        base = F.when(F.lower(F.left(number, F.lit(1))) == "x", 16).otherwise(10)
        short = F.when(F.length(digits) > 8, "99999999").otherwise(F.concat(F.lit("0"), digits))   # beyond the last
        code = F.when(base == 16, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10))
        name = F.regexp_extract(tail, r"^([a-zA-Z][a-zA-Z0-9]*;?)", 1)
        known = F.str_to_map(F.lit(REFERENCES), F.lit(_ENTRY), F.lit(_PAIR))
        symbol = F.try_element_at(known, name)
        after_number = F.regexp_replace(F.substr(tail, F.length(number) + 2), "^;", "")
        return F.when(number != "", F.concat(_character(code.cast("bigint")), after_number)).when(
            (name != "") & symbol.isNotNull(), F.concat(symbol, F.substr(tail, F.length(name) + 1)),
        ).otherwise(F.concat(F.lit("&"), tail))

    pieces = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.concat(
        F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, quoted or not; empty if it has none."""
    pattern = rf"""(?i)\s{name}\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|[^\s"'>]+)"""
    return decode_references(F.regexp_extract(tag, pattern, 1))


def page_pieces(html: ColumnLike) -> Column:
    """Tags and texts of a page in order, without comments, scripts and styles."""
    return F.regexp_extract_all(F.regexp_replace(col(html), HIDDEN_MARKUP, ""), F.lit(PIECE), F.lit(0))


def _is_tag(piece: Column) -> Column:
    return piece.rlike("^<[/!?a-zA-Z]")


def _tag_name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def element_from(pieces: Column, start: Column) -> Column:
    """Pieces after the opening tag at ``start`` (1-based) up to its closing tag."""
    name = _tag_name(F.get(pieces, start - 1))
    rest = F.slice(pieces, start + 1, F.size(pieces))

    def inside(tag: Column) -> Column:
        def walk(state: Column, piece: Column) -> Column:
            depth = F.when(
                ~_is_tag(piece) | (_tag_name(piece) != tag), state["depth"],
            ).when(F.startswith(piece, F.lit("</")), state["depth"] - 1).otherwise(state["depth"] + 1)
            return F.when(state["depth"] == 0, state).otherwise(F.struct(
                depth.alias("depth"), (state["length"] + 1).alias("length"),
            ))

        opened = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("length"))
        length = F.aggregate(rest, opened, walk)["length"]
        return F.when(tag.isin(*VOID_TAGS), F.slice(rest, 1, 0)).otherwise(
            F.slice(rest, F.lit(1), length))

    return let(name, inside)


def first_element(pieces: Column, *patterns: str) -> Column:
    """Inner pieces of the first element matching any of ``patterns``; null if none does."""
    return let(_first_place(pieces, "|".join(patterns)), lambda start: F.when(
        start > 0, element_from(pieces, start)))


def _first_place(pieces: Column, pattern: str, after: Column | None = None) -> Column:
    """1-based place of the first piece that matches, 0 if none does."""
    matches = F.transform(pieces, lambda piece, i: F.when(
        piece.rlike(pattern) if after is None else piece.rlike(pattern) & (i >= after), True))
    return F.coalesce(F.array_position(matches, True), F.lit(0)).cast("int")


def texts(inner: Column, separator: str) -> Column:
    """Visible texts of an element, each trimmed, joined by ``separator``."""
    visible = F.filter(
        F.transform(F.filter(inner, lambda p: ~_is_tag(p)), lambda p: strip(decode_references(p))),
        lambda p: p != "",
    )
    return F.array_join(visible, separator)


def raw_text(inner: Column) -> Column:
    """All text of an element as it stands, trimmed at the ends."""
    return strip(decode_references(F.array_join(F.filter(inner, lambda p: ~_is_tag(p)), "")))


def element_spans(pieces: Column, tag: str) -> Column:
    """``array<struct<start, stop>>``: places of the tags of every element of one name.

    An element without another of its name inside ends at the next such tag;
    only the others are walked through, so a long list stays linear.
    """
    tags = F.filter(
        F.transform(pieces, lambda piece, i: F.when(
            piece.rlike(any_tag(tag)), F.struct((i + 1).alias("place"), F.lit(True).alias("opens")),
        ).when(
            piece.rlike(rf"^</(?i:{tag})\s*>"), F.struct((i + 1).alias("place"), F.lit(False).alias("opens")),
        )),
        lambda found: found.isNotNull(),
    )

    def spans(found: Column) -> Column:
        def span(one: Column, i: Column) -> Column:
            following = F.get(found, i + 1)
            stop = F.when(~following["opens"], following["place"]).otherwise(
                one["place"] + 1 + F.size(element_from(pieces, one["place"])))
            return F.when(one["opens"], F.struct(one["place"].alias("start"), stop.alias("stop")))

        return F.filter(F.transform(found, span), lambda one: one.isNotNull())

    return let(tags, spans)


def span_text(pieces: Column, span: Column) -> Column:
    return raw_text(F.slice(pieces, span["start"] + 1, span["stop"] - span["start"] - 1))


def list_items(inner: Column) -> Column:
    """Texts of the list items of an element, in order."""
    return let(inner, lambda pieces: F.transform(
        element_spans(pieces, "li"), lambda span: span_text(pieces, span)))


def link_tags(pieces: Column, parent: str | None = None) -> Column:
    """Opening ``a`` tags; with ``parent``, only those that come first inside such a tag."""
    links = any_tag("a")
    if parent is None:
        return F.filter(pieces, lambda piece: piece.rlike(links))
    tags = F.filter(pieces, _is_tag)
    return let(tags, lambda all_tags: F.filter(all_tags, lambda tag, i: tag.rlike(links) & F.coalesce(
        F.get(all_tags, i - 1).rlike(parent), F.lit(False))))


def product_links(html: ColumnLike, base: str, pattern: str = r"/products/",
                  tag_pattern: str = any_tag("a"), parent: str | None = None,
                  prefix_all: bool = False) -> Column:
    """Addresses of the links whose ``href`` matches, in page order, with repeats.

    A leading ``/`` gets the site prefix; ``prefix_all`` puts it before every link.
    """
    links = F.transform(
        F.filter(let(page_pieces(html), lambda p: link_tags(p, parent)), lambda tag: tag.rlike(tag_pattern)),
        lambda tag: attribute(tag, "href"),
    )
    wanted = F.filter(links, lambda link: (link != "") & link.rlike(pattern))
    if prefix_all:
        return F.transform(wanted, lambda link: F.concat(F.lit(base), link))
    return F.transform(wanted, lambda link: F.when(
        link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link))


def child_of(pieces: Column, patterns: tuple[str, ...], tag: str) -> Column:
    """Inner pieces of the first ``tag`` that is a direct child of an element matching ``patterns``."""
    def child(inner: Column) -> Column:
        def walk(state: Column, piece: Column) -> Column:
            void = _tag_name(piece).isin(*VOID_TAGS) | ~piece.rlike("^</?[a-zA-Z]")
            found = F.when((state["found"] == 0) & (state["depth"] == 0) & piece.rlike(any_tag(tag)),
                           state["place"]).otherwise(state["found"])
            depth = F.when(void, state["depth"]).when(
                F.startswith(piece, F.lit("</")), state["depth"] - 1).otherwise(state["depth"] + 1)
            return F.struct(depth.alias("depth"), (state["place"] + 1).alias("place"), found.alias("found"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("place"), F.lit(0).alias("found"))
        return let(F.aggregate(inner, start, walk)["found"], lambda place: F.when(
            place > 0, element_from(inner, place)))

    return let(first_element(pieces, *patterns), child)


def title_of(pieces: Column, tag_pattern: str, pieces_trimmed: bool = True) -> Column:
    inner = first_element(pieces, tag_pattern)
    return texts(inner, "") if pieces_trimmed else raw_text(inner)


def block_of(pieces: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[texts(first_element(pieces, pattern), " ") for pattern in patterns])


def items_after(pieces: Column, heading: str, word: str, container: str) -> Column:
    """List items of the next sibling ``container`` of the last heading that contains ``word``.

    Empty without such a heading; null if one of the headings has no such sibling.
    """
    named = F.filter(
        element_spans(pieces, heading), lambda span: F.contains(span_text(pieces, span), F.lit(word)))
    none = F.array().cast("array<string>")

    def sibling(rest: Column) -> Column:
        """Place in ``rest`` of the first such tag before the parent of the heading closes."""
        def walk(state: Column, piece: Column) -> Column:
            void = _tag_name(piece).isin(*VOID_TAGS) | ~piece.rlike("^</?[a-zA-Z]")
            open_ = (state["found"] == 0) & (state["depth"] == 0)
            found = F.when(open_ & piece.rlike(any_tag(container)), state["place"]).when(
                open_ & F.startswith(piece, F.lit("</")), -1).otherwise(state["found"])
            depth = F.when(void, state["depth"]).when(
                F.startswith(piece, F.lit("</")), state["depth"] - 1).otherwise(state["depth"] + 1)
            return F.struct(depth.alias("depth"), (state["place"] + 1).alias("place"), found.alias("found"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("place"), F.lit(0).alias("found"))
        return let(F.aggregate(rest, start, walk)["found"], lambda place: F.when(
            place > 0, list_items(element_from(rest, place))))

    def after(span: Column) -> Column:
        return let(F.slice(pieces, span["stop"] + 1, F.size(pieces)), sibling)

    return let(F.transform(named, after), lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, none).when(
        F.forall(found, lambda items: items.isNotNull()), F.get(found, F.size(found) - 1)))


def items_in(pieces: Column, pattern: str) -> Column:
    return F.coalesce(list_items(first_element(pieces, pattern)), F.array().cast("array<string>"))


def images_of(pieces: Column) -> Column:
    sources = F.transform(
        F.filter(pieces, lambda piece: piece.rlike(any_tag("img"))),
        lambda tag: attribute(tag, "src"),
    )
    remote = F.filter(sources, lambda source: source.startswith("http"))
    return F.array_join(F.array_distinct(remote), ",")


def page_title(html: ColumnLike, tag_pattern: str = any_tag("h1")) -> Column:
    """Text of the first heading; null if the page has none."""
    return let(page_pieces(html), lambda pieces: title_of(pieces, tag_pattern))


def page_price(html: ColumnLike, *patterns: str) -> Column:
    """Text of the first element, in page order, that matches any pattern."""
    return let(page_pieces(html), lambda pieces: texts(first_element(pieces, *patterns), ""))


def page_materials(html: ColumnLike, *patterns: str) -> Column:
    """Text of the block matched by the first pattern, in order of priority, that matches."""
    return let(page_pieces(html), lambda pieces: block_of(pieces, patterns))


def page_material_items(html: ColumnLike, heading: str, word: str, container: str) -> Column:
    """List items of the container after the last heading that contains ``word``."""
    return let(page_pieces(html), lambda pieces: items_after(pieces, heading, word, container))


def page_images(html: ColumnLike, length: int | None = None) -> Column:
    """Distinct ``http`` image addresses joined by commas; with ``length``, cut at so many characters."""
    images = let(page_pieces(html), images_of)
    return images if length is None else F.left(images, F.lit(length))


@dataclass(frozen=True)
class SiteRules:
    """Where one shop keeps its product fields."""

    brand: str
    base: str
    link_pattern: str = r"/products/"
    link_tag: str = any_tag("a")
    link_parent: str | None = None
    prefix_all: bool = False
    name: str = any_tag("h1")
    price: tuple[str, ...] = ()
    price_child: str | None = None      # the price is the first such direct child
    materials: tuple[str, ...] = ()
    material_items: tuple[str, str, str] | None = None
    material_block: str | None = None
    keep_incomplete: bool = True


# Selectors of the five shops.
SITES = {
    "reformation": SiteRules(
        brand="Reformation",
        base="https://www.thereformation.com",
        price=(has_attribute("data-testid", "product-price"), has_class("price"),
               attribute_contains("class", "Price")),
        materials=(has_attribute("data-testid", "accordion"), attribute_contains("data-testid", "details"),
                   attribute_contains("class", "details"), attribute_contains("class", "accordion")),
    ),
    "everlane": SiteRules(
        brand="Everlane",
        base="https://www.everlane.com",
        price=(attribute_contains("data-test", "Price"), has_class("ProductPrice"), has_class("price")),
        materials=(attribute_contains("data-test", "Description"), attribute_contains("class", "description"),
                   attribute_contains("class", "details")),
    ),
    "patagonia": SiteRules(
        brand="Patagonia",
        base="https://www.patagonia.com",
        link_pattern="", link_tag=has_class("product-tile__link", "a"), prefix_all=True,
        name=has_class("product-name", "h1"),
        price=(has_class("price", "span"),),
        material_block=has_attribute("id", "product-materials", "div"),
        keep_incomplete=False,
    ),
    "hm": SiteRules(
        brand="H&M",
        base="https://www2.hm.com",
        link_pattern="", link_parent=has_class("product-item", "li"), prefix_all=True,
        price=(has_class("price-value"),),
        material_items=("dt", "Composition", "dd"),
        keep_incomplete=False,
    ),
    "zara": SiteRules(
        brand="Zara",
        base="",
        link_pattern="", link_parent=has_class("product-grid__product-list-item", "li"), prefix_all=True,
        name=has_class("product-detail-info__header-name", "h1"),
        price=(has_class("product-detail-info__price", "p"),),
        price_child="span",
        material_items=("p", "Composition", "ul"),
        keep_incomplete=False,
    ),
}


def site_links(html: ColumnLike, rules: SiteRules) -> Column:
    return product_links(
        html, rules.base, rules.link_pattern, rules.link_tag, rules.link_parent, rules.prefix_all)


def product_record(html: ColumnLike, rules: SiteRules) -> Column:
    """``struct<name, price_raw, materials, images>`` of one product page, cut up once."""

    def fields(pieces: Column) -> Column:
        price = child_of(pieces, rules.price, rules.price_child) if rules.price_child else first_element(
            pieces, *rules.price)
        if rules.material_block:
            materials = items_in(pieces, rules.material_block)
        elif rules.material_items:
            materials = items_after(pieces, *rules.material_items)
        else:
            materials = block_of(pieces, rules.materials)
        return F.struct(
            title_of(pieces, rules.name, rules.keep_incomplete).alias("name"),
            (texts(price, "") if rules.keep_incomplete else raw_text(price)).alias("price_raw"),
            materials.alias("materials"),
            images_of(pieces).alias("images"),
        )

    return let(page_pieces(html), fields)
