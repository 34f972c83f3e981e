"""Pages of many layouts with known labels, made by a grammar that the labelled pages of the fit don't come from."""

import random


def page(seed: int) -> str:
    """A page whose content blocks open with `§`. Half of the pages name no element or class that tells content from the rest."""
    rnd = random.Random(seed)
    plain = rnd.random() < 0.5
    words = lambda n: " ".join(rnd.choice(["sea", "harbour", "boat", "night", "town", "quiet", "storm"]) for _ in range(n))
    sentence = lambda low, high: words(rnd.randint(low, high)).capitalize() + "."
    links = lambda n: "".join(f"<{item}><a href=x>{words(rnd.randint(1, 3))}</a></{item}>" for item in [rnd.choice(["li", "span", "td", "div"])] for _ in range(n))

    def named(name: str, kind: str, inner: str) -> str:
        if plain:
            return f"<div>{inner}</div>"
        return rnd.choice([f"<{name}>{inner}</{name}>", f"<div class='{kind}'>{inner}</div>", f"<{name} id={kind}>{inner}</{name}>"])

    def content() -> str:
        parts = [f"<h1>§{words(rnd.randint(2, 7))}</h1>"] if rnd.random() < 0.8 else []
        for _ in range(rnd.randint(3, 9)):
            kind = rnd.random()
            if kind < 0.55:
                parts.append(f"<p>§{sentence(15, 70)}</p>")
            elif kind < 0.75:
                parts.append(f"<p>§{rnd.choice([sentence(1, 4), words(rnd.randint(1, 3))])}</p>")
            elif kind < 0.83:
                parts.append("<ul>" + "".join(f"<li>§{rnd.choice([words(rnd.randint(2, 6)), sentence(4, 12)])}" for _ in range(rnd.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<h2>§{words(rnd.randint(1, 5))}</h2><p>§{sentence(10, 40)}</p>")
            elif kind < 0.95:
                parts.append(f"<p>§<a href=x>{words(rnd.randint(2, 5))}</a> {sentence(5, 20)}</p>")
            elif not plain:
                parts.append(f"<div class=ad>{sentence(5, 12)}</div>")
        return "".join(parts)

    header = named("header", "masthead", f"<a href=/>{words(2)}</a>") + named("nav", "menu", links(rnd.randint(3, 7)))
    side = named("aside", "sidebar", f"<h3>{words(2)}</h3>{links(rnd.randint(2, 6))}") if rnd.random() < 0.6 else ""
    comments = named("section", "comments", "".join(f"<p>{sentence(5, 60)}</p>" for _ in range(rnd.randint(1, 3)))) if not plain and rnd.random() < 0.4 else ""
    footer = named("footer", "footer", f"{words(3)} {rnd.choice(['', links(2)])}<div>{words(rnd.randint(2, 6))}</div>")
    body = named(*rnd.choice([("article", "post"), ("main", "content")]), content())
    return f"<html><body>{header}{side if rnd.random() < 0.5 else ''}{body}{side}{comments}{footer}</body></html>"
