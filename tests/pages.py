"""Hand-made listing pages."""

from html import escape


def cell(value):
    return "" if value is None else escape(value, quote=False)


def line(drug, link, company, protocol, pub_date):
    anchor = cell(drug) if link is None else f'<a href="{escape(link)}">{cell(drug)}</a>'
    return "<tr><td>x</td>" + "".join(
        f"<td>{c}</td>" for c in (anchor, cell(company), cell(protocol), cell(pub_date))
    ) + "</tr>"


def pager(current, last):
    following = min(current + 1, last)
    return (
        f'<ul class="pagination"><li class="active"><a>{current}</a></li><li><a>{following}</a></li>'
        f'<li><a ng-switch-when="last">{last}</a></li></ul>'
    )


def sizes(items):
    return f'<div class="ng-table-counts"><button class="btn">10</button><button class="btn active">{items}</button></div>'


def page(rows, current=1, last=1, items=2):
    body = "".join(line(*r) for r in rows)
    return f"{sizes(items)}<table><tr><th>Drug</th></tr>{body}</table>{pager(current, last)}"


def rows_for(category, number, count, tag=""):
    return [
        (f"D{category}-{number}-{k}{tag}", f"#/{category}/{number}/{k}", "Co", f"P{category}-{number}-{k}", "01/02/2020")
        for k in range(count)
    ]


def category(number, counts, batch=0, items=2, tag=""):
    """Landed pages of a category with the given number of rows on each page."""
    last = len(counts)
    return [
        (number, i + 1, batch, page(rows_for(number, i + 1, n, tag), i + 1, last, items)) for i, n in enumerate(counts)
    ]
