"""Pages written by hand without telling names, before the labeller was run on any of them: "[+ +]" is
text of the article, "[- -]" text that is not."""

PLAIN = [
    "<body><p>[+Only one paragraph stands on this page, and it tells all that its author wanted to say.+]</p></body>",
    "<body>[+The ferry leaves at six from the old pier, whatever the weather, and takes forty minutes to the island.+]</body>",
    "<html><body><div>[+The first frost came in the second week of October.+]</div><div>[+We covered the lemon trees with old blankets and hoped.+]</div><div>[+Three of them lived, and one has flowered since.+]</div></body></html>",
    "<body><div>[+Six bridges cross the river between the mill and the sea.+]</div><div>[+The oldest was built of oak and burned twice.+]</div><div>[+The second carries the railway, which no longer runs.+]</div><div>[+The third is for walkers alone and sways in the wind.+]</div><div>[+The fourth was moved here from another town.+]</div><div>[+The last two are of concrete and nobody loves them.+]</div></body>",
    '<body><div class="x1">[-We use cookies to improve your experience, accept or change your settings.-]</div><div class="x2">[+The museum has opened its new hall of clocks, where the great astronomical one strikes again after forty years.+]</div><div class="x2">[+Its makers had left no drawings, so two watchmakers took it apart and measured every wheel.+]</div><div class="x3">[-Subscribe to our newsletter and never miss a story.-]</div></body>',
    "<body><h1>[+How to sharpen a scythe+]</h1><p>[+Peen the edge on a small anvil until it is thin as paper.+]</p><p>[+Then draw the wet stone along it, from the heel to the tip, every few minutes while you mow.+]</p></body>",
    '<body><div class="a9"><a href="/">[-Home-]</a></div><div class="a9"><a href="/b">[-About-]</a></div><div class="a9"><a href="/c">[-Contact-]</a></div><div class="k2">[+The council has voted to keep the swimming pool open for another year, though the roof must be mended before winter.+]</div><div class="k2">[+The mayor said that the money would come from the sale of the old fire station.+]</div></body>',
    "<body>[+It was raining when we reached the pass.+]<br>[+Nobody spoke.+]<br>[+Below us the valley lay in a light that none of us had seen before, green and very still.+]</body>",
    '<body><p>[+Bread needs four things: flour, water, salt and time.+]</p><ul><li>[+Mix the first three and let them rest for an hour.+]</li><li>[+Fold the dough every half hour, four times.+]</li><li>[+Leave it in the cold overnight.+]</li></ul><p>[+Bake it in a very hot oven, under a lid for the first half.+]</p></body>',
    '<body><div id="q7"><div>[+Why do swifts never land?+]</div><div>[+Their legs are so short that they can hardly take off from flat ground, and they find all they need in the air.+]</div><div>[+They drink, feed and even sleep on the wing, rising at dusk to great heights.+]</div></div><div id="q8">[-Copyright 2019 all rights reserved. Terms of service and privacy policy.-]</div></body>',
    '<body><table><tr><td>[+The orchard in spring+]</td></tr><tr><td>[+The plum is first, then the pear, and the apple waits until the nights are mild.+]</td></tr><tr><td>[+By the end of May the ground is white with petals and the bees have gone elsewhere.+]</td></tr></table></body>',
    '<body><section><p>[+A short note on the tides here: the flood runs for five hours and the ebb for seven.+]</p></section><section><p>[+Plan your return accordingly, for the channel dries out completely.+]</p></section></body>',
    '<body><div class="z">[-Advertisement. Buy now and save, free shipping on all orders today only.-]</div><p>[+The trial of the new tram began on Monday with an empty carriage and a bag of sand for each passenger.+]</p><p>[+Engineers will measure how the rails settle, and people may ride from the autumn on.+]</p></body>',
    "<body><pre>[+Dear all, the meeting is moved to Thursday because the hall is being painted. Please bring your own chairs.+]</pre></body>",
    '<body><div class="m"><div class="n"><h2>[+Old roads+]</h2></div><div class="n">[+The drovers took their cattle over the hills to spare the tolls, and their tracks can be seen where the snow melts last.+]</div><div class="n">[+Inns stood a day apart.+]</div></div><div class="o"><a href="1">[-Most read stories-]</a></div><div class="o"><a href="2">[-Latest posts-]</a></div></body>',
    "<body><blockquote>[+I never meant to stay, she wrote, and stayed for fifty years.+]</blockquote><p>[+Her letters fill eleven boxes, of which the library has opened two.+]</p></body>",
    '<body><div class="t4">[+Rain is expected from the west by noon, with gusts on the coast and snow above a thousand metres.+]</div><div class="t5"><form><input name="q"><button>[-Search-]</button></form></div><div class="t6">[-Follow us and share this on social media-]</div></body>',
    "<p>[+No body tag, no head, just this sentence and the next.+]<p>[+Browsers show it all the same, and so should whoever reads it.+]",
    '<body><div>[+The lake froze in January and the whole town went out on it.+]</div><div>[+Someone had hung lanterns.+]</div><div>[+Children who could not skate were pulled along on trays.+]</div><div><p>[-Reply-]</p><p>[-Thanks for posting, I agree with the comment above, great report-]</p></div></body>',
    '<body><h1>[+Mending nets+]</h1><div>[+Cut the torn meshes back to a clean edge with three legs at the top and at the bottom.+]</div><div>[+Wind the needle, begin at the top, and tie each knot around your finger so that all meshes come out alike.+]</div><div>[+End where three legs wait for you.+]</div></body>',
    '<body><span>[+Inline elements alone make up this page, and the words run on as one block of text until it ends.+]</span></body>',
    '<body><div class="b1"><div>[-Sign in to your account-]</div><div>[-Help-]</div></div><div class="b2"><div>[+The comet can be seen low in the east before sunrise, to the left of the brightest star.+]</div><div>[+A pair of field glasses shows its tail, which has grown since the weekend.+]</div></div><div class="b3"><div>[-Powered by nothing, copyright and imprint, contact us-]</div></div></body>',
]
