"""Pages labelled by hand, block by block, on which the block classifier of `htmltext` is fitted."""

from __future__ import annotations

import re

#: 24 page skeletons. `§` opens a block of the main text. `{n}` stands for a sentence of n words, `{-n}` for n words without
#: a full stop.
SKELETONS = (
    "<header><a>{-2}</a></header><nav><ul><li><a>{-1}</a><li><a>{-1}</a><li><a>{-2}</a></ul></nav><article><h1>§{-5}</h1><p>§{60}<p>§{1}<p>§{30}<ul><li>§{-4}<li>§{-6}</ul><p>§{12}</article><aside><h3>{-2}</h3><p>{25}</p></aside><section id=comments><h2>{-2}</h2><p>{40}<p>{8}<p>{120}</section><footer>{-6}</footer>",
    "<div><a>{-1}</a> <a>{-1}</a> <a>{-1}</a></div><div><h2>§{-4}</h2><p>§{50}<p>§{3}<p>§{70}<blockquote>§{20}</blockquote><p>§{-4}<p>§{35}</div><div>{-5}</div><div><a>{-2}</a> | <a>{-1}</a></div>",
    "<table><tr><td><a>{-1}</a><br><a>{-2}</a><br><a>{-1}</a><br><a>{-2}</a><td><h1>§{-6}</h1>§{80}<br>§{40}<br>§{2}<br>§{60}<tr><td>{-3}</table>",
    "<div id=content><h1>§{-7}</h1><p>§{35}<div class=ad>{9}</div><p>§{55}<p>§{4}<div class=share><a>{-1}</a> <a>{-1}</a></div><p>§{28}</div><div id=footer>{-12}</div>",
    "<div class=cookie-banner>{18} <a>{-1}</a></div><main><h1>§{-3}</h1><p>§{44}<p>§{21}<p>§{2}</main><form><p>{11}<p>{-2}</form><div class=copyright>{-5}</div>",
    "<nav><a>{-1}</a></nav><main><article><h2>§{-6}</h2><p>§{90}<p>§{15}</article></main><section class=related><h3>{-2}</h3><article><h4><a>{-6}</a></h4><p>{14}</article><article><h4><a>{-7}</a></h4><p>{22}</article></section>",
    "<nav><ul><li><a>{-1}</a><li><a>{-1}</a></ul></nav><article><h1>§{-1}</h1><p>§{1}</article><footer>{-7}</footer>",
    "<nav><ul><li><a>{-1}</a><li><a>{-1}</a></ul></nav><div class=ad>{6}</div><article><h1>§{1}</h1><p>§{2}</article><footer>{14}</footer>",
    "<div class='layout main-with-sidebar'><div class=sidebar><ul><li><a>{-3}</a><li><a>{-4}</a></ul><p>{16}</div><main><p>§{33}<p>§{5}<div class=post-share>{9}</div><p>§{41}</main></div>",
    "§{30}",
    "<h1>§{-4}</h1><p>§{75}<p>§{-2}<p>§{66}<p>§{1}<p>§{48}",
    "<article><h1>§{-5}</h1><p>§{24}<pre>§{-18}</pre><table><tr><th>§{-1}<th>§{-1}<tr><td>§{-1}<td>§{-2}<tr><td>§{-1}<td>§{-1}</table><p>§{37}</article><div class=newsletter><p>{13}</div>",
    "<article><h1>§{-8}</h1><p>§{52}<h2>§{-1}</h2><ul><li><a>§{-4}</a><li><a>§{-5}</a></ul><p>§{26}</article><div class=menu><a>{-1}</a><a>{-1}</a></div>",
    "<div class=breadcrumb><a>{-1}</a> / <a>{-1}</a></div><div class=entry-content><header><h1>§{-6}</h1></header><p>§{47}<figure><figcaption>§{7}</figcaption></figure><p>§{58}<p>§{3}</div><div class=notice>{62}</div><footer><p>{64}<p>{70}</footer>",
    "<div><ul><li><a>{-9}</a><li><a>{-8}</a><li><a>{-11}</a><li><a>{-7}</a></ul></div><div><p>§{38}<p>§{72}<p>§{6}<p>§{19}</div><div><p>{-3}<p>{-2} <a>{-1}</a></div>",
    "<div><div><a>{-2}</a></div><div>{-3}</div></div><div><div>§{61}</div><div>§{-5}</div><div>§{54}</div><div>§{-3}</div><div>§{83}</div></div><div><div>{-4}</div><div><a>{-2}</a></div></div>",
    "<article><h1>§{-4}</h1><p>§{29}</article><section class=comment-list><article class=comment><p>{51}<p>{2}</article><article class=comment><p>{77}</article><article class=reply><p>{140}</article></section>",
    "<header><h1>{-2}</h1><p>{8}</header><div class=story><p>§{64}<p>§{11}<ol><li>§{14}<li>§{9}<li>§{3}</ol><p>§{1}</div><div class=promo><h3>{-4}</h3><p>{23}</div>",
    "<div role=navigation><a>{-1}</a><a>{-2}</a></div><div role=main><h1>§{-5}</h1><p>§{43}<dl><dt>§{-1}<dd>§{17}<dt>§{-2}<dd>§{4}</dl></div><div role=contentinfo>{34}</div>",
    "<dialog><p>{32}</dialog><article><p>§{88}<aside><p>{18}</aside><p>§{56}<nav><a>{-2}</a></nav><p>§{7}</article>",
    "<body><p>{-2}<p><a>{-1}</a> <a>{-1}</a> <a>{-1}</a><p>§{65}<p>§{45}<p>§{2}<p>§{57}<p><a>{-1}</a> <a>{-2}</a><p>{-3}",
    "<footer>{90}</footer><form>{66}</form><aside>{72}</aside><nav>{64}</nav><main><p>§{22}</main>",
    "<div class=sponsored><p>{68}<p>{75}</div><div class=post><p>§{31}<p>§{2}</div><div class=comments><div><p>{95}<p>{110}<p>{67}</div></div>",
    "<article><p>§{10}<p>§{1}<p>§{-1}<p>§{-2}<p>§{8}</article><div class=skip>{-3}</div>",
)


def pages() -> list[str]:
    """The labelled pages with words for the placeholders."""
    words = lambda m: " ".join(["word"] * abs(int(m[1]))) + "." * (int(m[1]) > 0)
    return [re.sub(r"\{(-?\d+)\}", words, s) for s in SKELETONS]
