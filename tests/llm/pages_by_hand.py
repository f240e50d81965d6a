"""Pages written by hand in the manner of common sites, each with its main blocks, marked by hand; no generator made them."""

PAGES = {
    "blog": (
        """<!DOCTYPE html><html lang="en-US"><head><meta charset="UTF-8"><title>Repairing a wooden window – The Old House Diary</title>
<link rel="stylesheet" href="/style.css"><script>window.dataLayer = window.dataLayer || [];</script></head>
<body class="post-template-default single single-post"><div id="page" class="site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">The Old House Diary</a></p><p class="site-description">Notes from a slow renovation</p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about/">About</a></li><li class="menu-item"><a href="/contact/">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-1382" class="post-1382 post type-post hentry">
<header class="entry-header"><h1 class="entry-title">Repairing a wooden window</h1></header>
<div class="entry-content"><p>The north window had been leaking since we moved in. Last weekend I finally took it out of its frame.</p>
<p>Most of the rot was in the sill, which is common: water runs down the glass and stays there. I cut out everything soft and let the rest dry for two days.</p>
<h2>What you need</h2><ul><li>A sharp chisel</li><li>Two-part epoxy</li><li>Linseed oil putty, about half a kilogram</li></ul>
<p>When the epoxy has set, sand it flush. Then prime the bare wood with thinned oil and wait until it is no longer <em>tacky</em>.</p></div></article>
<nav class="navigation post-navigation"><div class="nav-links"><div class="nav-previous"><a href="/a">Stripping paint</a></div><div class="nav-next"><a href="/b">A new gutter</a></div></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on “Repairing a wooden window”</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><footer class="comment-meta"><b>Marit</b> says:</footer><div class="comment-content"><p>We did the same last year, and it still looks good. Did you use a heat gun for the old putty?</p></div></article></li></ol>
<div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form action="/c"><p>Your email address will not be published.</p><label>Comment</label><textarea></textarea></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">Stripping paint</a></li><li><a href="/b">A new gutter</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a weblog engine</div></footer></div></body></html>""",
        ["Repairing a wooden window", "The north window had been leaking since we moved in. Last weekend I finally took it out of its frame.", "Most of the rot was in the sill, which is common: water runs down the glass and stays there. I cut out everything soft and let the rest dry for two days.", "What you need", "A sharp chisel", "Two-part epoxy", "Linseed oil putty, about half a kilogram", "When the epoxy has set, sand it flush. Then prime the bare wood with thinned oil and wait until it is no longer tacky."],
    ),
    "news": (
        """<!doctype html><html lang="en"><head><title>Harbour bridge reopens</title></head><body>
<div class="cookie-banner" role="dialog"><p>We and our partners store information on your device. You can change your mind at any time.</p><button>Accept all</button></div>
<header class="global-header"><a href="/">The Coast Courier</a><nav><ul><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main><article class="story"><h1>Harbour bridge reopens after eleven months</h1>
<div class="story-body"><p>Traffic returned to the harbour bridge on Monday morning, eleven months after a barge struck its southern pier.</p>
<div class="ad-slot" id="ad-1">Advertisement</div>
<p>The repair cost 14 million, the port authority said. It was paid by the insurers of the shipping company.</p>
<figure><img src="b.jpg" alt="The bridge"><figcaption>The southern pier was rebuilt from the river bed up.</figcaption></figure>
<p>“We are relieved,” said the owner of a bakery near the ramp. “Half of our customers come from the other side.”</p>
<section class="related-links"><h2>More on this story</h2><ul><li><a href="/1">Barge hits bridge at night</a></li><li><a href="/2">Ferry runs every ten minutes</a></li></ul></section>
<p>Buses will use the bridge again from Thursday.</p></div></article></main>
<aside class="most-read"><h2>Most read</h2><ol><li><a href="/3">Storm warning for the weekend</a></li><li><a href="/4">School gets a new roof</a></li></ol></aside>
<div class="newsletter"><form><h3>Get the morning letter</h3><p>The day's news in your inbox at seven.</p><input type="email"><button>Sign up</button></form></div>
<footer><ul><li><a href="/terms">Terms of use</a></li><li><a href="/privacy">Privacy</a></li></ul><p>Copyright 2023 The Coast Courier. All rights reserved.</p></footer></body></html>""",
        ["Harbour bridge reopens after eleven months", "Traffic returned to the harbour bridge on Monday morning, eleven months after a barge struck its southern pier.", "The repair cost 14 million, the port authority said. It was paid by the insurers of the shipping company.", "The southern pier was rebuilt from the river bed up.", "“We are relieved,” said the owner of a bakery near the ramp. “Half of our customers come from the other side.”", "Buses will use the bridge again from Thursday."],
    ),
    "manual": (
        """<html><head><title>Configuration — widgetd 2.4 documentation</title></head><body>
<div class="topbar"><a href="index.html">widgetd</a><form class="search" action="/search"><input name="q"><input type="submit" value="Go"></form></div>
<div class="sidebar" role="navigation"><ul><li><a href="install.html">Installation</a></li><li><a href="config.html">Configuration</a><ul><li><a href="#files">Files</a></li><li><a href="#options">Options</a></li></ul></li><li><a href="faq.html">Questions</a></li></ul></div>
<div class="document"><div class="body" role="main"><h1>Configuration</h1>
<p>The daemon reads one file at start. Its place is given by the option <code>-c</code>; without it, the file in the working directory is used.</p>
<h2>Files</h2><p>A file consists of sections. Lines that begin with a hash are ignored.</p><pre>[server]
port = 8080</pre>
<h2>Options</h2><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>port</td><td>Number of the port, 8080 if not given</td></tr><tr><td>threads</td><td>How many requests are served at once</td></tr></table>
<ol><li>Stop the daemon.</li><li>Edit the file.</li><li>Start it again.</li></ol></div></div>
<div class="footer">Built with a documentation tool. <a href="source.txt">Page source</a></div></body></html>""",
        ["Configuration", "The daemon reads one file at start. Its place is given by the option -c; without it, the file in the working directory is used.", "Files", "A file consists of sections. Lines that begin with a hash are ignored.", "[server] port = 8080", "Options", "Name", "Meaning", "port", "Number of the port, 8080 if not given", "threads", "How many requests are served at once", "Stop the daemon.", "Edit the file.", "Start it again."],
    ),
    "tables of the nineties": (
        """<HTML><HEAD><TITLE>My page about moths</TITLE></HEAD><BODY BGCOLOR="#FFFFFF">
<TABLE WIDTH="100%" BORDER=0><TR><TD COLSPAN=2 ALIGN=CENTER><A HREF="index.htm">Home</A> | <A HREF="links.htm">Links</A> | <A HREF="guest.htm">Guestbook</A>
<TR><TD WIDTH=120 VALIGN=TOP><A HREF="hawk.htm">Hawk moths</A><BR><A HREF="tiger.htm">Tiger moths</A><BR><A HREF="owlet.htm">Owlet moths</A>
<TD VALIGN=TOP><FONT FACE="Arial"><H1>Hawk moths</H1>
<P>Hawk moths are strong fliers. Some of them hover in front of flowers like small birds.
<P>The largest one here is the <B>death's-head</B>, which squeaks when it is touched. I have seen it only twice, both times in a hot summer.
<P>Their caterpillars have a horn at the end.</FONT></TABLE></BODY></HTML>""",
        ["Hawk moths", "Hawk moths are strong fliers. Some of them hover in front of flowers like small birds.", "The largest one here is the death's-head, which squeaks when it is touched. I have seen it only twice, both times in a hot summer.", "Their caterpillars have a horn at the end."],
    ),
    "recipe": (
        """<!doctype html><html><head><title>Lentil soup</title></head><body><div class="wrapper"><div id="header"><div class="logo"><a href="/">Plain Kitchen</a></div><ul class="nav"><li><a href="/soups">Soups</a></li><li><a href="/bread">Bread</a></li></ul></div>
<div id="main-content"><div class="breadcrumbs"><a href="/">Home</a> » <a href="/soups">Soups</a></div><h1>Red lentil soup</h1><p>A soup for cold evenings that needs half an hour and one pot.</p>
<div class="social-share"><a href="#">Share</a> <a href="#">Pin</a> <a href="#">Print</a></div>
<h3>Ingredients</h3><ul class="ingredients"><li>200 g red lentils</li><li>1 onion</li><li>2 carrots</li></ul>
<h3>Method</h3><ol class="steps"><li>Fry the chopped onion until it is soft.</li><li>Add the carrots, the lentils and a litre of water.</li><li>Cook for twenty minutes. Add salt at the end only.</li></ol>
<p>It tastes better on the second day.</p></div>
<div class="comments"><h3>Comments</h3><div class="comment"><strong>Jo</strong><p>Made this twice already. My children love it.</p></div><div class="comment"><strong>Ana</strong><p>I added cumin, and it was great.</p></div></div>
<div id="footer"><p>© Plain Kitchen 2019 · <a href="/imprint">Imprint</a></p></div></div></body></html>""",
        ["Red lentil soup", "A soup for cold evenings that needs half an hour and one pot.", "Ingredients", "200 g red lentils", "1 onion", "2 carrots", "Method", "Fry the chopped onion until it is soft.", "Add the carrots, the lentils and a litre of water.", "Cook for twenty minutes. Add salt at the end only.", "It tastes better on the second day."],
    ),
    "bare": (
        """<title>Letter</title><h1>A letter from the valley</h1>
<p>The snow came early this year. By the first week of November the road was closed, and we had to carry the milk down on foot.
<p>Nobody complained. It is always like this, my neighbour said, and then he told me about the winter of his childhood, when the stream froze to its bed.
<p>I am sending this with the last post before the holidays.
<hr><address>Copyright by the author. Last changed in December.</address>""",
        ["A letter from the valley", "The snow came early this year. By the first week of November the road was closed, and we had to carry the milk down on foot.", "Nobody complained. It is always like this, my neighbour said, and then he told me about the winter of his childhood, when the stream froze to its bed.", "I am sending this with the last post before the holidays."],
    ),
    "german": (
        """<!DOCTYPE html><html lang="de"><head><title>Stadtbücherei</title></head><body><div id="kopf"><h2><a href="/">Stadtbücherei Altenfeld</a></h2></div>
<div id="navigation" class="nav"><ul><li><a href="/katalog">Katalog</a></li><li><a href="/zeiten">Öffnungszeiten</a></li><li><a href="/kontakt">Kontakt</a></li></ul></div>
<div id="content"><h1>Neue Räume für die Kinderbücherei</h1><p>Nach dem Umbau öffnet die Kinderbücherei am Samstag wieder. Im Erdgeschoss ist nun Platz für 6.000 Bücher und eine kleine Bühne.</p>
<p>Zur Eröffnung liest die Autorin aus ihrem neuen Buch. Der Eintritt ist frei; Anmeldung ist nicht nötig.</p>
<p>Die Ausleihe bleibt kostenlos für alle unter achtzehn Jahren.</p></div>
<div id="sidebar"><h3>Termine</h3><ul><li><a href="/t1">Lesekreis am Montag</a></li><li><a href="/t2">Flohmarkt</a></li></ul></div>
<div id="footer"><a href="/impressum">Impressum</a> | <a href="/datenschutz">Datenschutz</a></div></body></html>""",
        ["Neue Räume für die Kinderbücherei", "Nach dem Umbau öffnet die Kinderbücherei am Samstag wieder. Im Erdgeschoss ist nun Platz für 6.000 Bücher und eine kleine Bühne.", "Zur Eröffnung liest die Autorin aus ihrem neuen Buch. Der Eintritt ist frei; Anmeldung ist nicht nötig.", "Die Ausleihe bleibt kostenlos für alle unter achtzehn Jahren."],
    ),
    "utility classes": (
        """<!doctype html><html lang="en"><head><title>Release 9</title></head><body class="antialiased text-slate-700"><header class="sticky top-0 z-40 flex items-center justify-between px-6 py-4"><a href="/" class="font-bold">Quarry</a><nav class="hidden md:flex gap-6"><a href="/docs">Docs</a><a href="/pricing">Pricing</a><a href="/blog">Blog</a></nav></header>
<main class="mx-auto max-w-3xl px-4 py-12"><h1 class="text-4xl font-extrabold tracking-tight">Release 9 is here</h1><div class="prose mt-8"><p>Version 9 reads twice as fast as version 8 on the same machine. The format of the files hasn't changed.</p><p>We removed three options that nobody used. If you still have them in your settings, you get a warning at start, and nothing else happens.</p><blockquote><p>The best release is one that you don't notice.</p></blockquote><p>Thanks to all who sent reports.</p></div></main>
<footer class="border-t py-10 text-sm text-slate-500"><div class="flex justify-center gap-4"><a href="/imprint">Imprint</a><a href="/status">Status</a></div><p class="mt-4">© 2024 Quarry Ltd.</p></footer></body></html>""",
        ["Release 9 is here", "Version 9 reads twice as fast as version 8 on the same machine. The format of the files hasn't changed.", "We removed three options that nobody used. If you still have them in your settings, you get a warning at start, and nothing else happens.", "The best release is one that you don't notice.", "Thanks to all who sent reports."],
    ),
    "lesson": (
        """<html><head><title>Right triangles<body><nav><a href=/>Lessons</a> <a href=/tests>Tests</a></nav><article><h1>Right triangles</h1>
<video controls><source src="a.mp4"><p>Your browser can't play this film.</p></video>
<p>In a right triangle with the sides <math><mi>a</mi></math> and <math><mi>b</mi></math> the longest side follows from <math><msup><mi>a</mi><mn>2</mn></msup><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><annotation encoding="tex">a^2+b^2</annotation></math>.</p>
<p>Draw the squares over the sides, <svg viewBox="0 0 9 9"><title>squares</title><text>9</text></svg> and compare their areas.</p>
<noscript><p>Please switch on scripts.</p></noscript><p>You will find that the two smaller ones make up the largest.</p></article><footer>Lesson 12 of 30</footer></body></html>""",
        None,
    ),
    "press": (
        """<!DOCTYPE html><html><body><div class="container"><div class="row"><div class="col-md-3 left-col"><ul class="list-unstyled"><li><a href="/press">All releases</a></li><li><a href="/media">Media kit</a></li><li><a href="/people">Contacts</a></li></ul></div>
<div class="col-md-9"><div class="alert alert-warning">This is an archived page and is no longer updated.</div><h1>New observatory sees first light</h1>
<p>The observatory on the plateau has taken its first picture. It shows a cluster of young stars some 1,200 light years away.</p><p>Construction took nine years. The mirror, which has a diameter of six metres, was cast in a single piece and polished for twenty months.</p>
<p>Regular observations will begin in spring.</p><div class="tags">Tags: <a href="/t/space">space</a>, <a href="/t/optics">optics</a></div></div></div></div>
<div class="footer-links"><a href="/jobs">Jobs</a> <a href="/legal">Legal notice</a></div></body></html>""",
        ["New observatory sees first light", "The observatory on the plateau has taken its first picture. It shows a cluster of young stars some 1,200 light years away.", "Construction took nine years. The mirror, which has a diameter of six metres, was cast in a single piece and polished for twenty months.", "Regular observations will begin in spring."],
    ),
    "magazine": (
        """<!DOCTYPE html><html lang="fr"><head><title>Le jardin en automne</title></head><body><div class="page-wrapper"><div class="top-banner ads">Abonnez-vous et recevez un sac en toile.</div><header class="header"><div class="brand">Terre et Saison</div><nav class="menu"><a href="/plantes">Plantes</a><a href="/outils">Outils</a></nav></header>
<section class="article-content"><h1>Le jardin en automne</h1><h2>Semer avant le gel</h2><p>Octobre est le mois des engrais verts. On les sème dès que les tomates sont arrachées.</p><p>La phacélie lève en une semaine ; elle gèle en hiver et laisse une terre souple.</p><div class="promo-box sponsored"><p>Découvrez nos sécateurs à prix doux. Livraison offerte.</p></div><h2>Planter les bulbes</h2><p>Une tulipe se plante à trois fois sa hauteur. Plus profond, elle fleurit plus longtemps.</p></section>
<section class="recommended"><h3>À lire aussi</h3><a href="/1">Tailler un rosier</a> <a href="/2">Pailler sans plastique</a></section><footer class="footer"><p>Mentions légales</p></footer></div></body></html>""",
        ["Le jardin en automne", "Semer avant le gel", "Octobre est le mois des engrais verts. On les sème dès que les tomates sont arrachées.", "La phacélie lève en une semaine ; elle gèle en hiver et laisse une terre souple.", "Planter les bulbes", "Une tulipe se plante à trois fois sa hauteur. Plus profond, elle fleurit plus longtemps."],
    ),
    "encyclopedia": (
        """<!DOCTYPE html><html><head><title>Salt road</title></head><body class="skin"><div id="mw-head" role="navigation"><ul><li><a href="/read">Read</a></li><li><a href="/edit">Edit</a></li><li><a href="/history">View history</a></li></ul></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading">Salt road</h1><div id="bodyContent"><div id="siteSub" class="noprint notice">From a free collection of texts</div><div class="mw-parser-output"><p>A <b>salt road</b> is a trade route on which salt was carried to regions that lacked it.</p>
<div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#history">1 History</a></li><li><a href="#routes">2 Routes</a></li></ul></div>
<h2 id="history">History</h2><p>Salt was needed to keep meat and fish. From the Bronze Age on it was moved over long distances, mostly on the backs of animals.</p><h2 id="routes">Routes</h2><p>Several roads led from the mines to the coast. The best known one has been in use for two thousand years.</p></div></div></div>
<div id="mw-panel" role="navigation"><h3>Tools</h3><ul><li><a href="/w">What links here</a></li><li><a href="/p">Printable version</a></li></ul></div><footer id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May.</li><li>Text is available under a free license.</li></ul></footer></body></html>""",
        ["Salt road", "A salt road is a trade route on which salt was carried to regions that lacked it.", "History", "Salt was needed to keep meat and fish. From the Bronze Age on it was moved over long distances, mostly on the backs of animals.", "Routes", "Several roads led from the mines to the coast. The best known one has been in use for two thousand years."],
    ),
}
#: Its title is never closed, so a browser takes the whole page for it up to the first element of a body.
PAGES["lesson"] = (PAGES["lesson"][0].replace("Right triangles<body>", "Right triangles</title><body>", 1), ["Right triangles", "In a right triangle with the sides a and b the longest side follows from a2+b2.", "Draw the squares over the sides,", "and compare their areas.", "You will find that the two smaller ones make up the largest."])
