"""Pages of a small site that several tests read."""

SITE = "https://d.example/"
PAGES = {
    "docs/": '<html><head><title>Home tag</title></head><body><nav role="navigation">'
    '<a href="/docs/nav-only">N</a></nav><h1> Docs Home </h1><div class="toc big"><ul>'
    '<li><a href="guide/">G</a></li><li><a href="api/ref">R</a></li>'
    '<li><a href="/docs/search">S</a></li><li><a href="https://other.example/docs/x">X</a></li>'
    '<li><a href="guide/#top">T</a></li><li><a href="/blog/">B</a></li>'
    '<li><a href="missing">M</a></li><li><a href="">E</a></li></ul></div>'
    '<p>Hello  world</p><script>var a="</p>";</script></body></html>',
    "docs/guide/": '<html><head><title>Guide</title></head><body><div class="toc">'
    '<a href="../">Up</a><a href="intro">I</a></div><p>Read <a href="../api/ref">ref</a> or '
    '<a href="/docs/guide/intro?x=1">q</a>.</p></body></html>',
    "docs/api/ref": '<html><body><div class="sidebar-menu"><div><a href="/docs/api/ref/deep/er">D</a>'
    "</div></div>\n  R&eacute;f &amp; more \U0001f600\n\n\n\nend</body></html>",
    "docs/guide/intro": "<html><head><title>Intro</title></head><body><h1>  </h1>"
    '<p>One<br>Two<p>Three<footer><a href="/docs/legal">L</a></footer>',
    "docs/api/ref/deep/er": '<html><body><h1>Deep</h1><a href="mailto:a@b.example">m</a>'
    '<a href="./er2">e</a></body></html>',
    "docs/legal": "<h1>Legal</h1>",
    "docs/nav-only": "<h1>Nav only</h1>",
    "blog/": "<h1>Blog</h1>",
    "docs/search": "<h1>Search</h1>",
}
