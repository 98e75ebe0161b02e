"""A layout as one SVG text a page: its rows become elements, joined in drawing order by page. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HEX_COLORS, negative_strand, with_commas
from ..operators.layout import page_title
from ..sources.stored import stored
from .gene_layout import GeneLayout

#: The page, its two panels (left and right edges), and a slot's rows, in units of the drawing.
WIDTH, HEIGHT = 1100, 850
GENOME, PROTEIN = (70.0, 560.0), (620.0, 1060.0)
TOP, SLOT = 170.0, 160.0
EXON_Y, PROTEIN_Y, DOMAIN_Y, LABEL_Y, CAPTION_Y = 62.0, 40.0, 85.0, 112.0, 150.0
EXON_HEIGHT, THIN_HEIGHT, PROTEIN_HEIGHT, DOMAIN_HEIGHT, TRACK = 36.0, 18.0, 20.0, 30.0, 120.0


def escaped(c: Column) -> Column:
    """Text of an XML element or attribute: without control characters, marks as entities."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def hex_color(index: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, HEX_COLORS)), F.pmod(index, F.lit(len(HEX_COLORS))).cast("int") + 1), F.lit("#000000"))


def _element(kind: str, more: Column | None = None, **attributes: Column | str | float) -> Column:
    """<kind a="..." ...>: numbers with two decimals."""
    texts: list[Column] = [F.lit(f"<{kind}")]
    for name, value in attributes.items():
        value = value if isinstance(value, Column) else F.lit(f"{value:.2f}" if isinstance(value, float) else value)
        texts += [F.lit(f' {name.replace("_", "-")}="'), value, F.lit('"')]
    return F.concat(*texts, F.lit("/>") if more is None else F.concat(F.lit(">"), more, F.lit(f"</{kind}>")))


def _n(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def _text(x: Column | float, y: Column | float, size: int, text: Column, anchor: str = "start", **more: Column | str) -> Column:
    return _element("text", escaped(text), **{"class": "t"}, x=x, y=y, font_size=str(size), text_anchor=anchor, **more)


def page_documents(drawn: GeneLayout) -> DataFrame:
    """gene_ensembl_id, cluster, page (from 0), svg: a document for each page that has a transcript.

    Of an overlay there is one for each cluster and page of its drawn gene, with the cluster's brackets, and its junction
    table on the first page; else cluster is null. A page's text is made of its own rows, a few transcripts of them.

    What is drawn of a transcript comes to one row, and these to their gene, where texts are made behind the last shuffle.
    No side of these joins is sent to the driver: their files are small, but not their rows.
    """
    at = drawn["transcripts"].select("gene_ensembl_id", "tx", "page", "slot", "caption", "axis_max")
    of_tx = lambda df, name, *fields: df.groupBy("tx").agg(F.collect_list(F.struct(*fields)).alias(name)).hint("merge")
    segment_colors = drawn.segment_colors.groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("segment", "color"))).alias("segment_colors"))
    parts = drawn["exon_parts"].groupBy("tx").agg(F.collect_set(F.struct("part", "start", "end")).alias("parts"))
    rows = at
    for piece in (
        parts.hint("merge"), segment_colors.hint("merge"), of_tx(drawn["backbone"], "segments", "position", "start_aa", "end_aa"),
        of_tx(drawn["shapes"], "shapes", "domain", "z", "center", "width", "fill", "color"),
        of_tx(drawn["strips"], "strips", "domain", "strip", "center", "strip_height", "segment"), of_tx(drawn["labels"].withColumnRenamed("key", "tx"), "labels", "center", "text", "lane"),
    ):
        rows = rows.join(piece, "tx", "left")
    # Written, so that neither plan has all of the layout's scans.
    rows = stored(rows, "document-transcripts")

    exon = F.struct((F.greatest("gs", "ge") - F.least("gs", "ge")).alias("n"), "color", F.least("gs", "ge").alias("es"), F.greatest("gs", "ge").alias("ee"))
    colors = drawn["exon_colors"].groupBy("gene_ensembl_id").agg(F.array_sort(F.collect_list(exon)).alias("exon_colors"))
    negative = drawn.genes.groupBy("gene_ensembl_id").agg(F.max(negative_strand(F.col("strand"))).alias("negative"))
    extent = drawn.extents.select("gene_ensembl_id", "genomic_start", "genomic_end").join(negative.hint("merge"), "gene_ensembl_id")

    first = lambda found, name: F.get(found, F.lit(0))[name]
    holding = lambda p: F.filter("exon_colors", lambda c: (p["start"] >= c["es"]) & (p["end"] <= c["ee"]))  # noqa: E731  the shortest first
    own_color = lambda k: first(F.filter("segment_colors", lambda c: c["segment"] == k), "color")
    shape_of = lambda s: F.filter("shapes", lambda d: d["domain"] == s["domain"])
    colored = lambda items, color: F.transform(items, lambda e: e.withField("color", color(e)))
    rows = rows.join(colors.hint("merge"), "gene_ensembl_id", "left").withColumns({
        "parts": colored("parts", lambda p: first(holding(p), "color")),
        "segments": colored("segments", lambda s: own_color(s["position"])),
        "strips": F.flatten(F.transform("strips", lambda s: F.transform(shape_of(s), lambda d: s.withField("color", own_color(s["segment"])).withField("z", d["z"]).withField("width", d["width"])))),
    }).drop("exon_colors", "segment_colors")
    pages = rows.groupBy("gene_ensembl_id", "page").agg(F.max("axis_max").alias("axis_most"), F.collect_list(F.struct("slot", "caption", "axis_max", "parts", "segments", "shapes", "strips", "labels")).alias("transcripts"))
    out = pages.join(extent.hint("merge"), "gene_ensembl_id").join(drawn.titled.hint("merge"), "gene_ensembl_id")

    low, high = F.col("genomic_start"), F.greatest(F.col("genomic_end"), F.col("genomic_start") + 1)

    def genome(c: Column) -> Column:
        along = (c - low) / (high - low)
        return F.lit(GENOME[0]) + F.when(F.col("negative"), 1 - along).otherwise(along) * F.lit(GENOME[1] - GENOME[0])

    def span(kind: str, x1: Column, x2: Column, y: Column, height: Column | float, fill: Column, **more: str) -> Column:
        height = F.lit(height) if isinstance(height, float) else height
        left = F.least(x1, x2)
        return _element("rect", **{"class": kind}, x=_n(left), y=_n(y - height / 2), width=_n(F.greatest(x1, x2) - left), height=_n(height), fill=fill, **more)

    def elements(t: Column) -> Column:
        y, axis = F.lit(TOP) + t["slot"] * F.lit(SLOT), t["axis_max"]
        protein = lambda c: F.lit(PROTEIN[0]) + c / axis * F.lit(PROTEIN[1] - PROTEIN[0])
        item = lambda layer, place, element: F.struct(F.lit(layer).alias("layer"), t["slot"].alias("slot"), place.cast("double").alias("place"), element.alias("element"))
        each = lambda name, layer, place, element: F.coalesce(F.transform(t[name], lambda e: item(layer, place(e), element(e))), F.array())

        def part(e: Column) -> Column:
            coding = e["part"] == "coding"
            height, opacity = F.when(coding, F.lit(EXON_HEIGHT)).otherwise(F.lit(THIN_HEIGHT)), F.when(coding, F.lit("1")).otherwise(F.lit("0.35"))
            return span("exon", genome(e["start"]), genome(e["end"]), y + EXON_Y, height, hex_color(e["color"]), fill_opacity=opacity)

        def strip(e: Column) -> Column:
            half = e["width"] / 160
            return span("strip", protein(e["center"] - half), protein(e["center"] + half), y + DOMAIN_Y, e["strip_height"] * F.lit(TRACK), hex_color(e["color"]))

        def domain(e: Column) -> Column:
            fill = F.when(e["fill"] == "strips", F.lit("none")).otherwise(hex_color(e["color"]))
            return _element("ellipse", **{"class": "domain"}, cx=_n(protein(e["center"])), cy=_n(y + DOMAIN_Y), rx=_n(e["width"] / 2 / axis * (PROTEIN[1] - PROTEIN[0])), ry=DOMAIN_HEIGHT / 2, fill=fill, fill_opacity="0.8", stroke="black")

        return F.concat(
            F.array(
                item(0, F.lit(0), _element("line", **{"class": "transcript"}, x1=GENOME[0], x2=GENOME[1], y1=_n(y + EXON_Y), y2=_n(y + EXON_Y), stroke="black")),
                item(0, F.lit(1), _text(GENOME[0], _n(y + CAPTION_Y), 10, t["caption"])),
                item(2, F.lit(0), _element("rect", **{"class": "protein"}, x=PROTEIN[0], y=_n(y + PROTEIN_Y - PROTEIN_HEIGHT / 2), width=_n(protein(axis) - PROTEIN[0]), height=PROTEIN_HEIGHT, fill="white", stroke="black")),
            ),
            each("parts", 1, lambda e: e["start"], part),
            each("segments", 3, lambda e: e["start_aa"], lambda e: span("segment", protein(e["start_aa"]), protein(e["end_aa"]), y + PROTEIN_Y, PROTEIN_HEIGHT, hex_color(e["color"]))),
            each("strips", 4, lambda e: e["z"] * 2 + e["strip"] / F.lit(1000.0), strip),
            each("shapes", 4, lambda e: e["z"] * 2 + 1, domain),
            each("labels", 5, lambda e: e["center"], lambda e: _text(_n(protein(e["center"])), _n(y + LABEL_Y + e["lane"] * 9), 8, e["text"], "middle")),
        )

    in_order = lambda items: F.array_join(F.transform(F.array_sort(items), lambda e: e["element"]), "\n")
    scale = F.concat_ws(
        "\n",
        _element("line", **{"class": "scale"}, x1=GENOME[0], x2=GENOME[1], y1=150.0, y2=150.0, stroke="black"), _element("line", **{"class": "scale"}, x1=PROTEIN[0], x2=PROTEIN[1], y1=150.0, y2=150.0, stroke="black"),
        _text(GENOME[0], 145.0, 8, with_commas(F.when(F.col("negative"), high).otherwise(low))), _text(GENOME[1], 145.0, 8, with_commas(F.when(F.col("negative"), low).otherwise(high)), "end"),
        _text(PROTEIN[0], 145.0, 8, F.lit("0")), _text(PROTEIN[1], 145.0, 8, with_commas(F.floor("axis_most")), "end"),
    )
    body = in_order(F.flatten(F.transform("transcripts", elements)))
    title = page_title(F.col("title"), F.col("page"), F.col("n_pages"))
    out = out.select("gene_ensembl_id", "page", title.alias("title"), scale.alias("scale"), body.alias("body"))
    if drawn.report is None:
        out = out.withColumns({"cluster": F.lit(None).cast("string"), "own": F.lit("")})
    else:
        y = F.lit(TOP) + F.col("slot") * F.lit(SLOT)
        brackets = drawn["brackets"].drop("slot").join(at, "tx").join(extent, "gene_ensembl_id")
        shown = brackets.join(drawn.drawings.select("cluster", "gene_ensembl_id"), ["cluster", "gene_ensembl_id"])
        base, top = y + EXON_Y - EXON_HEIGHT / 2, y + EXON_Y - (F.col("top") - F.lit(0.5)) * F.lit(TRACK)
        line = F.concat(F.lit("M"), _n(genome(F.col("left"))), F.lit(" "), _n(base), F.lit(" V"), _n(top), F.lit(" H"), _n(genome(F.col("right"))), F.lit(" V"), _n(base))
        own = shown.select(
            "cluster", "page", F.lit(6).alias("layer"), "slot", F.col("idx").cast("double").alias("place"),
            _element("path", **{"class": "bracket"}, d=line, fill="none", stroke=hex_color(F.col("color"))).alias("element"),
        )
        table = drawn["junction_table"].select(
            "cluster", F.lit(0).cast("bigint").alias("page"), F.lit(7).alias("layer"), F.lit(0).cast("bigint").alias("slot"), F.col("idx").cast("double").alias("place"),
            _text(GENOME[0], _n(F.lit(44.0) + F.col("idx").cast("double") * 9), 7, F.concat_ws("  ", "idx", "junction_name", "gene_id", "comparison_results"), fill=hex_color(F.col("color"))).alias("element"),
        )
        own = own.unionByName(table).groupBy("cluster", "page").agg(in_order(F.collect_list(F.struct("layer", "slot", "place", "element"))).alias("own"))
        out = out.join(drawn.drawings, "gene_ensembl_id").join(own, ["cluster", "page"], "left")
    start = F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif">')
    svg = F.concat_ws("\n", start, _text(WIDTH / 2, 28.0, 14, F.col("title"), "middle", font_weight="bold"), "scale", "body", "own", F.lit("</svg>"))
    return out.select("gene_ensembl_id", "cluster", "page", svg.alias("svg"))
