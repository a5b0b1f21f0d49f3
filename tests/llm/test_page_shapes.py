"""Main text of page shapes whose text is known: tags never closed, site builders, doubtful class names, and random pages."""

import random

import pytest

from quillgrid.llm.mainext import main_text

SAYS = [f"Paragraph number {i} tells a long enough story about the sea and its many islands, with commas and a full stop at the end." for i in range(6)]
ART = "".join(f"<p>{x}</p>" for x in SAYS)
ALL = "\n".join(SAYS)
HEAD = "<h1>Head</h1>"
WIDGETS = "".join(f'<div class="elementor-widget elementor-widget-text"><p>{x}</p></div>' for x in SAYS)
SHAPES = {
    "head not closed": (f"<html><head><title>x</title><meta charset=utf-8><body><nav><a href=/>Home</a></nav><article>{HEAD}{ART}</article></body></html>", f"Head\n{ALL}"),
    "no body": (f"<head><title>x</title><div>{HEAD}{ART}</div>", f"Head\n{ALL}"),
    "button not closed": (f"<body><article>{HEAD}<button>Like{ART}</article><footer>f</footer></body>", f"Head\n{ALL}"),
    "select not closed": (f"<body><article>{HEAD}<div><select><option>a<option>b</div>{ART}</article><footer>f</footer></body>", f"Head\n{ALL}"),
    "object not closed": (f"<body><article>{HEAD}<object data=x>{ART}</article></body>", f"Head\n{ALL}"),
    "canvas not closed": (f"<body><article>{HEAD}<canvas id=c>{ART}</article></body>", f"Head\n{ALL}"),
    "noscript closed": (f"<body><article>{HEAD}<button>Ok</button><noscript><h2>No</h2><p>Please enable scripts in your browser to see this page in full.</p></noscript>{ART}</article></body>", f"Head\n{ALL}"),
    "site builder": (f"<body><header><a href=/>Home</a></header>{WIDGETS}<footer>(c) x</footer></body>", ALL),
    "related work": (f'<body><article>{HEAD}{ART}<section class="related-work"><h2>Related work</h2><p>Earlier studies did not look at islands at all.</p></section></article></body>', f"Head\n{ALL}\nRelated work\nEarlier studies did not look at islands at all."),
    "share price": (f'<body><main>{HEAD}{ART}<div class="share-price">The price of a share rose by three per cent.</div></main></body>', f"Head\n{ALL}\nThe price of a share rose by three per cent."),
    "share bar": (f'<body><article>{HEAD}{ART}<div class="share-buttons"><a href=x>Share</a><a href=y>Tweet</a></div><div class="related-posts"><ul><li><a href=z>Another story of the sea</a></li></ul></div></article></body>', f"Head\n{ALL}"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    html, want = SHAPES[name]
    assert main_text(html) == want


def page(r):
    """A random page and its main text."""
    word = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()} {word()}</a></li>' for _ in range(n))
    text, body = [line(4)], []
    body.append(f"<h1>{text[0]}</h1>")
    for k in range(r.randint(4, 9)):
        said = line(r.randint(18, 60))
        body.append(r.choice([f"<p>{said}</p>", f"<p>{said}", f"<div><p>{said}</p></div>", f'<div class="{r.choice(["elementor-widget", "text-widget", "row", "col-md-8"])}"><p>{said}</p></div>']))
        text.append(said)
        if k % 3 == 1:
            text.append(line(3))
            body.append(f"<h2>{text[-1]}</h2>")
            text.append(line(30))
            body.append(f"<p>{text[-1]}</p>")
        if r.random() < 0.3:
            body.append(r.choice([f"<button>{word()}</button>", "<svg><text>x</text></svg>", f"<script>var a='{word()}';</script>", "<style>p{}</style>", f'<div class="share-bar"><a href=x>{word()}</a> <a href=y>{word()}</a></div>', f'<div class="ad-slot"><a href=x>{line(9)}</a></div>']))
    whole = "\n".join(body)
    whole = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content"><article>{}</article></div>', '<div class="with-sidebar"><section>{}</section></div>']).format(whole)
    around = [
        r.choice([f"<nav><ul>{links(6)}</ul></nav>", f'<div class="navbar"><ul>{links(5)}</ul></div>', f'<header><a href="/">{word()}</a><ul>{links(4)}</ul></header>']),
        whole,
        *r.sample([f"<aside><h3>{word()}</h3><ul>{links(5)}</ul></aside>", f'<div class="related-posts"><ul>{links(4)}</ul></div>', f'<section id="comments"><p>{line(14)}</p><p>{line(12)}</p></section>', f'<div class="cookie-banner"><p>{line(12)}</p><button>Ok</button></div>', f'<form action="/"><p>{line(7)}</p><input name=q></form>'], r.randint(1, 4)),
        f"<footer><p>{line(6)}</p><ul>{links(4)}</ul></footer>",
    ]
    head = r.choice(["<head><title>{0}</title></head>", "<head><meta charset=utf-8><title>{0}</title>", "<title>{0}</title>", ""]).format(word())
    return f"<!doctype html><html>{head}<body>{''.join(around)}</body></html>", "\n".join(text)


def test_random_pages():
    r = random.Random(11)
    held = found = wanted = whole = 0
    for _ in range(400):
        html, want = page(r)
        got, want = main_text(html).split("\n"), want.split("\n")
        held += sum(len(x) for x in got if x in set(want))
        found += sum(map(len, got))
        wanted += sum(map(len, want))
        whole += got == want
    assert held / wanted >= 0.98 and held / found >= 0.98, (held / wanted, held / found)
    assert whole >= 0.95 * 400, whole
