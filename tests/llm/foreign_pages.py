"""Pages written by hand, in layouts that the labeller's training grammar does not draw. Each is a list
of (markup around a text, text, belongs to the article); "{}" stands for the text."""

PAGES = [
    # a magazine: figure with caption inside, breadcrumb of spans, subscription box in the middle
    [
        ('<!doctype html><html lang="en"><head><title>x</title></head><body><div class="site-topbar"><div class="breadcrumb"><span><a href="/">{}</a></span></div></div>', "Home / Science", False),
        ('<div id="main-column"><div class="story"><h1 class="headline">{}</h1>', "Glaciers in the north lose mass faster than models foresaw", True),
        ('<div class="story-body"><p>{}</p>', "A survey of two hundred glaciers, carried out over eleven summers, found that thinning has doubled since the first measurements.", True),
        ("<p>{}</p>", "Researchers hauled radar sledges across the ice and compared the depth of old snow layers with satellite heights.", True),
        ('<div class="newsletter-promo"><p>{}</p></div>', "Subscribe to our newsletter and get the week in science by email.", False),
        ("<p>{}</p>", "The team expects the loss to slow only if summers cool again, which no forecast shows.", True),
        ("<blockquote><p>{}</p></blockquote></div></div></div>", "We had to redraw the map three times while writing the paper, said the leader of the expedition.", True),
        ('<div class="related-stories"><h4>{}</h4>', "Related stories", False),
        ('<ul><li><a href="/1">{}</a></li>', "Sea ice at a record low", False),
        ('<li><a href="/2">{}</a></li></ul></div>', "How to date a snow layer", False),
        ('<div class="footer-legal"><p>{}</p></div></body></html>', "Copyright 2021 Northern Review. All rights reserved. Terms of service, privacy policy.", False),
    ],
    # an old table layout without classes
    [
        ("<HTML><BODY BGCOLOR=white><TABLE><TR><TD COLSPAN=2><FONT SIZE=5><A HREF=index.html>{}</A></FONT></TD></TR>", "Harbour Pages", False),
        ("<TR><TD WIDTH=120><A HREF=a.html>{}</A><BR>", "Tides", False),
        ("<A HREF=b.html>{}</A><BR>", "Boats", False),
        ("<A HREF=c.html>{}</A></TD>", "Guestbook", False),
        ("<TD><H2>{}</H2>", "Splicing a three strand rope", True),
        ("<P>{}", "Unlay the strands for about six turns, whip each end, and marry the two ropes so that every strand lies between two of the other.", True),
        ("<P>{}", "Tuck each strand over one and under the next, against the lay, and pull it down firmly before you turn to the following one.", True),
        ("<P>{}</TD></TR>", "Five full tucks hold in natural fibre, while slippery synthetic rope wants seven.", True),
        ("<TR><TD COLSPAN=2><A HREF=mailto:x>{}</A></TD></TR></TABLE></BODY></HTML>", "Mail the webmaster", False),
    ],
    # documentation: side menu, tables and code in the article, pager below
    [
        ('<body><div class="docs-sidebar"><ul><li><a href="#">{}</a></li>', "Getting started", False),
        ('<li><a href="#">{}</a></li>', "Configuration", False),
        ('<li><a href="#">{}</a></li></ul></div>', "Reference", False),
        ('<main class="markdown"><h1>{}</h1>', "Configuring the scheduler", True),
        ("<p>{}</p>", "The scheduler reads its settings once, when the service starts, so a change takes effect after the next restart.", True),
        ("<h2>{}</h2>", "Queue settings", True),
        ("<table><tr><td>{}</td>", "max_depth", True),
        ("<td>{}</td></tr></table>", "Largest number of jobs that wait in one queue", True),
        ("<pre>{}</pre>", "queue: max_depth: 500", True),
        ("<p>{}</p>", "A queue that is full refuses new jobs until one of those waiting has begun.", True),
        ('</main><div class="pagination"><a href="/p">{}</a></div>', "Previous page", False),
        ('<div class="pagination"><a href="/n">{}</a></div></body>', "Next page", False),
    ],
    # a blog with reader comments in definition lists and a cookie bar at the end
    [
        ('<body><header role="banner"><p class="site-title"><a href="/">{}</a></p>', "The patient gardener", False),
        ('<p class="tagline">{}</p></header>', "Notes from a wet valley", False),
        ('<div class="entry hentry"><h2 class="entry-title">{}</h2>', "Why the beans failed", True),
        ('<div class="entry-content"><p>{}</p>', "In May the ground was still cold at a hand's depth, and the beans sat in it for three weeks before they rotted.", True),
        ("<p>{}</p>", "I sowed a second row in June, under old windows, and every seed came up within eight days.", True),
        ("<p>{}</p></div></div>", "Next year I shall wait until the soil, not the calendar, says that it is time.", True),
        ('<div id="comments"><h3>{}</h3>', "Two comments", False),
        ("<dl><dt>{}</dt>", "Martha says", False),
        ("<dd><p>{}</p></dd>", "I lost mine as well, thanks for writing this down, it was the same here in the hills.", False),
        ("<dt>{}</dt>", "Olek says", False),
        ("<dd><p>{}</p></dd></dl></div>", "Try runner beans, they mind the cold less than the others do.", False),
        ('<div id="cookie-bar"><p>{}</p></div></body>', "We use cookies to improve your experience, accept them or change your settings.", False),
    ],
    # a German newspaper page with adverts between paragraphs
    [
        ('<body><nav class="hauptmenue"><ul><li><a href="/">{}</a></li>', "Politik", False),
        ('<li><a href="/">{}</a></li></ul></nav>', "Wirtschaft", False),
        ('<article class="artikel"><h1>{}</h1>', "Stadtrat beschließt den Bau einer neuen Brücke", True),
        ('<p class="vorspann">{}</p>', "Nach zwölf Jahren Streit hat der Rat am Dienstag mit knapper Mehrheit für die Querung gestimmt.", True),
        ("<p>{}</p>", "Die Brücke soll im Frühjahr begonnen werden und den Verkehr aus der Altstadt an den östlichen Rand verlegen.", True),
        ('<aside class="advert"><p>{}</p></aside>', "Anzeige: Jetzt sparen, 20 % Rabatt auf alle Fahrräder.", False),
        ("<p>{}</p>", "Gegner kündigten an, vor Gericht zu ziehen, weil das Gutachten zum Lärm noch nicht vorliege.", True),
        ("</article><footer><p>{}</p></footer></body>", "Impressum, Datenschutz, Kontakt", False),
    ],
    # a recipe: lists in the article, share buttons, a form
    [
        ('<body><div class="share-buttons"><a href="#">{}</a></div>', "Share this", False),
        ('<section class="recipe"><h1>{}</h1>', "Barley soup with leeks", True),
        ("<p>{}</p>", "A thick soup for cold evenings, which tastes better on the second day.", True),
        ("<ul><li>{}</li>", "two hundred grams of pearl barley", True),
        ("<li>{}</li>", "three leeks, washed and cut into rings", True),
        ("<li>{}</li></ul>", "one litre of stock", True),
        ("<ol><li>{}</li>", "Soften the leeks in butter over a low flame.", True),
        ("<li>{}</li></ol></section>", "Add the barley and the stock, and simmer for fifty minutes.", True),
        ('<form action="/rate"><label>{}</label>', "Your email", False),
        ("<button>{}</button></form>", "Send", False),
        ('<div class="widget_tags"><a href="#">{}</a></div></body>', "soup", False),
    ],
    # nearly no markup: a plain report in one container, a disclaimer with a telling class after it
    [
        ("<body><h1>{}</h1>", "Minutes of the spring meeting", True),
        ("<p>{}</p>", "The chair opened the meeting at seven and welcomed nineteen members.", True),
        ("<p>{}</p>", "The treasurer reported a surplus of four hundred, most of it from the plant sale, and the accounts were approved.", True),
        ("<p>{}</p>", "It was agreed to mend the roof of the shed before winter.", True),
        ("<p>{}</p>", "The next meeting will be held on the first of October.", True),
        ('<div class="disclaimer">{}</div></body>', "This site uses cookies. By using it you accept our privacy policy.", False),
    ],
    # self-closing slashes on links and containers, which HTML ignores
    [
        ("<body><div class=menu /><p><a href=/a/>{}</a></p>", "Start", False),
        ("<p><a href=/b/>{}</a></p></div>", "Archive", False),
        ("<article><h1>{}</h1>", "A walk along the canal", True),
        ("<p>{}</p>", "We set out at dawn from the lock, with the towpath still white, and met nobody before the second bridge.", True),
        ("<p>{}</p></article>", "By noon the frost was gone, and the whole town seemed to be on the water.", True),
        ("<footer /><p>{}</p></footer></body>", "All rights reserved", False),
    ],
]
