"""Pages written and labelled by hand, after layouts of other makes than the training generator's: page -> its content blocks."""

A, B, C, D = (
    "The council met on Tuesday to discuss the new bridge, which has been closed for repairs since the floods of last spring.",
    "Engineers said that two of the pillars would have to be replaced before traffic could return, and that the work might last until autumn.",
    "Shop owners on the far bank complained about lost trade.",
    "A second hearing is planned for the end of the month, when the cost of the repairs will be known.",
)

PAGES = [
    # a weblog theme
    (f'<html><head><title>x</title></head><body class="home blog"><div id="page"><div id="masthead" class="site-header"><a href="/">My weblog</a><ul class="nav-menu"><li><a href="/a">About</a><li><a href="/b">Archive</a></ul></div>'
     f'<div id="primary"><div class="post hentry"><h1 class="entry-title">Bridge closed</h1><div class="entry-content"><p>{A}</p><p>{B} <a href="/more">Plans</a> are public.</p><blockquote><p>{C}</p></blockquote><p>{D}</p></div></div>'
     f'<div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment">Nice post, thanks!</li><li class="comment"><p>I live there and it is bad.</p></li></ol></div></div>'
     f'<div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><div id="colophon" class="site-footer">Proudly made by hand</div></div></body></html>',
     ["Bridge closed", A, f"{B} Plans are public.", C, D]),
    # a plain page, nothing but headings and paragraphs
    (f"<html><body><h1>Notes on the bridge</h1><p>{A}<p>{B}<h2>Trade</h2><p>{C}<ul><li>The east side lost most of its visitors.</li><li>The west side gained some of them.</li></ul><p>{D}</body></html>",
     ["Notes on the bridge", A, B, "Trade", C, "The east side lost most of its visitors.", "The west side gained some of them.", D]),
    # an encyclopedia
    (f'<body><div id="siteSub" class="noprint menu"><a href="#c">Jump to content</a></div><main id="content"><h1 id="firstHeading">Bridge</h1><div class="mw-body-content"><p>{A}</p><h2>History</h2><p>{B}</p><p>{C}</p><table class="infobox"><tr><th>Length</th><td>240 m</td></tr></table><p>{D}</p></div></main>'
     f'<nav class="vector-menu"><ul><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></nav><footer><ul><li>This page was last edited yesterday.</li><li><a href="/p">Privacy policy</a></li></ul></footer></body>',
     ["Bridge", A, "History", B, C, "Length", "240 m", D]),
    # a newspaper
    (f'<body><header role="banner"><nav><a href="/">News</a><a href="/s">Sport</a></nav></header><div class="cookie-consent"><p>We use cookies to improve this site. Accept or manage them.</p></div><article class="story-body"><h1>Bridge stays shut</h1><p class="byline">By a reporter</p><p>{A}</p><div class="advert">Buy new tyres today</div><p>{B}</p><figure><img src=a><figcaption>The bridge in spring</figcaption></figure><p>{C}</p><p>{D}</p></article>'
     f'<aside class="most-read"><h2>Most read</h2><ol><li><a href="/1">Storm ahead</a></li><li><a href="/2">Match report</a></li></ol></aside><section class="newsletter"><form><p>Get our letter every morning</p><label>Mail</label><input></form></section><footer><p>All rights reserved.</p></footer></body>',
     ["Bridge stays shut", "By a reporter", A, B, "The bridge in spring", C, D]),
    # table layout of old
    (f'<html><body><table width=100%><tr><td colspan=2><a href="/">Home</a> | <a href="/x">Links</a> | <a href="/g">Guestbook</a></td></tr><tr><td><a href="/1">Page one</a><br><a href="/2">Page two</a></td><td><h1>The old bridge</h1><p>{A}</p><p>{B}</p><p>{D}</p></td></tr></table></body></html>',
     ["The old bridge", A, B, D]),
    # paragraphs as div elements without names
    (f'<body><div><div><ul><li><a href="/">Start</a></li><li><a href="/c">Contact</a></li></ul></div><div><h1>Closed until autumn</h1><div>{A}</div><div>{B}</div><div>{C}</div></div><div><form><label>Search</label><input><button>Go</button></form></div></div></body>',
     ["Closed until autumn", A, B, C]),
    # documentation
    (f'<body><div class="wy-nav-side sidebar"><ul><li><a href="i">Install</a></li><li><a href="u">Usage</a></li></ul></div><section class="wy-nav-content"><div role="main" class="document"><h1>Usage</h1><p>{A}</p><pre>open bridge --now</pre><p>{B}</p><dl><dt>--now</dt><dd>Does it at once, without asking.</dd></dl><p>{D}</p></div></section><div class="footer" role="contentinfo"><p>Built with love.</p></div></body>',
     ["Usage", A, "open bridge --now", B, "--now", "Does it at once, without asking.", D]),
    # straight in body, with bare noise around it
    (f'<body><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul><h1>Hearing planned</h1><p>{D}</p><p>{A}</p><p>{C}</p><p>{B}</p><div class="share-bar"><a href="t">Tweet</a></div><div class="footer">Copyright the town</div></body>',
     ["Hearing planned", D, A, C, B]),
]
