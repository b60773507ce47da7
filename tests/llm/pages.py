"""Pages written by hand, in layouts that no generator made, with the blocks of their main text."""

PAGES = [
    (
        """<!doctype html><html><head><title>Slow bread | The Kitchen Bench</title><style>p{color:red}</style></head><body class="home blog"><div id="top"><a href="/">The Kitchen Bench</a><ul id="mainnav"><li><a href="/r">Recipes</a><li><a href="/a">About me</a></ul></div>
<div class="hentry"><h1 class="entry-title">Slow bread for cold mornings</h1><div class="entry-content"><p>Mix the flour and the water the evening before, and leave the bowl in the coolest room of the house.</p><h2>What you need</h2><ul><li>500 g of strong flour</li><li>350 g of water</li><li>10 g of salt</li></ul><p>In the morning the dough should have doubled; fold it twice and let it rest while the oven heats.</p></div>
<div class="sharedaddy">Share this: <a href="#">Facebook</a> <a href="#">Mail</a></div></div><div id="comments"><h3>2 thoughts on bread</h3><ol class="commentlist"><li><p>Anna says: I tried it on Sunday and it was lovely!</p></li><li><p>Ben says: Mine did not rise at all.</p></li></ol></div><div id="secondary"><h3>Archives</h3><ul><li><a href="#">May</a><li><a href="#">June</a></ul></div><div id="colophon">Proudly powered by a printing press</div></body></html>""",
        ["Slow bread for cold mornings", "Mix the flour and the water the evening before, and leave the bowl in the coolest room of the house.", "What you need", "500 g of strong flour", "350 g of water", "10 g of salt", "In the morning the dough should have doubled; fold it twice and let it rest while the oven heats."],
    ),
    (
        """<html><body><header role="banner"><img src=logo><nav><a href=1>World</a> <a href=2>Sport</a> <a href=3>Culture</a></nav></header><main><article><header><h1>Harbour reopens after the storm</h1></header><p>Fishing boats left the harbour at dawn on Tuesday, nine days after the breakwater gave way.</p><aside class="pullquote-ad"><p>Advertisement: book your cruise today</p></aside><p>The port authority said that repairs to the eastern wall would take until autumn, but that larger vessels may enter at high tide.</p><blockquote><p>We have waited for this morning longer than I care to say, one skipper told us.</p></blockquote><p>Insurers have put the damage at eleven million.</p></article><section class="related-stories"><h2>More on this story</h2><ul><li><a href=x>Storm in pictures</a></li><li><a href=y>How breakwaters work</a></li></ul></section></main><footer><p>© The Coast Post. All rights reserved.</p><p><a href=t>Terms</a> <a href=p>Privacy</a></p></footer></body></html>""",
        ["Harbour reopens after the storm", "Fishing boats left the harbour at dawn on Tuesday, nine days after the breakwater gave way.", "The port authority said that repairs to the eastern wall would take until autumn, but that larger vessels may enter at high tide.", "We have waited for this morning longer than I care to say, one skipper told us.", "Insurers have put the damage at eleven million."],
    ),
    (
        """<html><body><div class="cookie-consent"><p>We value your privacy. We and our partners store information on a device.</p><button>Accept all</button></div><div class="layout"><div class="sidebar-left"><ul><li><a href=a>Getting started</a></li><li><a href=b>Configuration</a></li><li><a href=c>Deployment</a></li></ul></div><div class="doc-content"><h1>Configuration</h1><p>The server reads its settings from a file when it starts. Lines that begin with a hash are ignored.</p><pre>port = 8080
workers = 4</pre><p>Each setting may be overridden on the command line, which is useful for tests.</p><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>port</td><td>where the server listens</td></tr></table></div></div><footer class="page-footer">Edit this page | Last updated in March</footer></body></html>""",
        ["Configuration", "The server reads its settings from a file when it starts. Lines that begin with a hash are ignored.", "port = 8080 workers = 4", "Each setting may be overridden on the command line, which is useful for tests.", "Name", "Meaning", "port", "where the server listens"],
    ),
    (
        """<html><head><title>Owls</title></head><body><div id="header"><h2>Encyclopedia of Birds</h2><form action=s><input name=q><button>Search</button></form></div><div id="content"><h1>Barn owl</h1><p>The barn owl is found on every continent but one. <a href=k>Owls</a> of this family have a heart-shaped face.</p><h2>Voice</h2><p>It does not hoot; its call is a long, harsh scream that carries over open fields at night.</p><h2>Food</h2><p>Voles and mice make up most of its prey, and a pair with young may take several thousand in a year.</p></div><div id="footer"><p>This page was last changed on 3 May.</p><ul><li><a href=1>About</a></li><li><a href=2>Disclaimers</a></li></ul></div></body></html>""",
        ["Barn owl", "The barn owl is found on every continent but one. Owls of this family have a heart-shaped face.", "Voice", "It does not hoot; its call is a long, harsh scream that carries over open fields at night.", "Food", "Voles and mice make up most of its prey, and a pair with young may take several thousand in a year."],
    ),
    (
        """<html><body><div class="wrap"><div class="masthead"><a href=/>Ligne Claire</a></div><div class="menu"><a href=1>Accueil</a> | <a href=2>Archives</a></div><div class="post"><h2>Les jardins du canal</h2><p>Au bord du canal, les jardins ouvriers existent depuis plus d'un siècle et leurs cabanes n'ont guère changé.</p><p>On y cultive des haricots, des dahlias et, selon les voisins, beaucoup de patience.</p></div><div class="pager"><a href=3>Page suivante</a></div><div class="newsletter"><p>Recevez nos articles chaque semaine dans votre boîte.</p><form><input type=email></form></div><div class="foot">Mentions légales</div></div></body></html>""",
        ["Les jardins du canal", "Au bord du canal, les jardins ouvriers existent depuis plus d'un siècle et leurs cabanes n'ont guère changé.", "On y cultive des haricots, des dahlias et, selon les voisins, beaucoup de patience."],
    ),
    (
        """<html><body><nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/g>Guides</a></nav><section class="story"><h1>Walking the ridge in two days</h1><p>The ridge can be crossed in two days by anyone who starts early and carries enough water.</p><div class="ad-slot"><div>Sponsored: boots at half price</div></div><h3>Day one</h3><p>From the station follow the red marks to the chapel, where the forest ends. The hut is another three hours.</p><h3>Day two</h3><p>Leave before sunrise. The second half of the path has no shade, and storms build up after noon.</p></section><div class="author-box"><p>Mira Holt writes about mountains and trains.</p></div><section id="discussion"><h4>Reader comments</h4><div class="comment"><p>We did it in three and were glad of it.</p></div></section><footer>Contact | Imprint</footer></body></html>""",
        ["Walking the ridge in two days", "The ridge can be crossed in two days by anyone who starts early and carries enough water.", "Day one", "From the station follow the red marks to the chapel, where the forest ends. The hut is another three hours.", "Day two", "Leave before sunrise. The second half of the path has no shade, and storms build up after noon."],
    ),
    (
        """<html><body><div class="site-header"><h1>City Library</h1><p>Open Monday to Saturday</p></div><div class="main"><p>The reading room closes for repairs from the first of June. Books on loan may be returned at the side entrance during this time.</p><p>Reserved books are kept for two weeks longer than usual, and no fees will be charged before September.</p></div><div class="widget-area"><div class="widget"><h3>Opening hours</h3><p>9 to 18</p></div></div><div class="site-footer"><p>City Library, Market Square 2</p></div></body></html>""",
        ["The reading room closes for repairs from the first of June. Books on loan may be returned at the side entrance during this time.", "Reserved books are kept for two weeks longer than usual, and no fees will be charged before September."],
    ),
    (
        """<html><body><header><div class="logo">Data Letters</div></header><article class="markdown-body"><h1>Counting without remembering</h1><p>How many different visitors has a page had? The exact answer needs every name; a good guess needs a few kilobytes.</p><p>The trick is to look at hashes. Among many random numbers, one that begins with ten zeros is rare, so seeing one means that many were seen.</p><pre><code>def rank(h): return leading_zeros(h) + 1</code></pre><ol><li>Hash each name.</li><li>Keep the largest rank in each register.</li><li>Average the registers.</li></ol><p>That is all there is to it.</p></article><div class="tags"><a href=a>sketches</a> <a href=b>hashing</a></div><div class="recommended"><h3>You may also like</h3><a href=q>Bloom filters for gardeners</a></div><footer><small>Built with care.</small></footer></body></html>""",
        ["Counting without remembering", "How many different visitors has a page had? The exact answer needs every name; a good guess needs a few kilobytes.", "The trick is to look at hashes. Among many random numbers, one that begins with ten zeros is rare, so seeing one means that many were seen.", "def rank(h): return leading_zeros(h) + 1", "Hash each name.", "Keep the largest rank in each register.", "Average the registers.", "That is all there is to it."],
    ),
    (
        """<html><body><table width=100%><tr><td colspan=2 class=top><a href=1>Start</a> <a href=2>Forum</a> <a href=3>Links</a></td></tr><tr><td class=nav><a href=4>1998</a><br><a href=5>1999</a></td><td class=text><h1>My radio collection</h1><p>I bought my first radio at a flea market for the price of a sandwich, and it still plays.</p><p>Valves are harder to find each year. I keep a box of spares under the bed and hope for the best.</p></td></tr><tr><td colspan=2 class=bottom>You are visitor 10433</td></tr></table></body></html>""",
        ["My radio collection", "I bought my first radio at a flea market for the price of a sandwich, and it still plays.", "Valves are harder to find each year. I keep a box of spares under the bed and hope for the best."],
    ),
    (
        """<html><body><div class="alert">Your browser is out of date. <a href=u>Update now</a></div><main class="page-content"><h1>Minutes of the spring meeting</h1><p>Twenty-three members were present. The chair opened the meeting at seven and thanked the kitchen.</p><p>The accounts were read and approved without a vote against.</p><p>It was agreed to paint the boathouse before the season begins; volunteers meet on the second Saturday of April.</p></main><aside class="rail"><h2>Next dates</h2><ul><li>Regatta</li><li>Summer party</li></ul></aside><footer><a href=i>Imprint</a></footer></body></html>""",
        ["Minutes of the spring meeting", "Twenty-three members were present. The chair opened the meeting at seven and thanked the kitchen.", "The accounts were read and approved without a vote against.", "It was agreed to paint the boathouse before the season begins; volunteers meet on the second Saturday of April."],
    ),
]
