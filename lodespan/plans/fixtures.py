"""Small literal inputs that no table has: robots bodies, paths, sitemaps, feeds and search phrases."""

ROBOTS = [
    ("a.example", "Crawl-delay: 99\nUser-Agent: *\nAllow: /charts/open/\nDisallow: /charts/ # all others\nDisallow: /logs/\nUser-agent: visitor\nDisallow: /\nCrawl-delay: 8\nUser-agent: *\nCrawl-delay: 5"),
    ("b.example", "User-agent: LodespanBot/2\nDisallow: /tides/\n\n\nUser-agent: *\nDisallow: /ferries/\nSitemap: https://b.example/s.xml"),
    ("c.example", None),
    ("d.example", "USER-AGENT: *\r\nDISALLOW: /Kept/Case\r\nDisallow:\r\nCrawl-delay: soon\r\nCrawl-delay: 7"),
]
PATHS = ["/", "/charts/north", "/charts/open/east.png", "/logs/7", "/tides/today", "/ferries/2", "/kept/case", "/Kept/Case/3"]
AGENT = "lodespanbot"
SITEMAP = '<?xml version="1.0"?>\n<!-- two places -->\n<urlset xmlns="urn:x">\n <url><lastmod>2024</lastmod><loc>\n https://island.test/ferries</loc></url>\n <url><loc>tides/today</loc></url>\n</urlset>\n'
FEED = '<rss><channel><title>News &amp; more</title><link>https://example.com/</link><description>All</description><item><title>One</title><link>https://example.com/one</link><description><![CDATA[<b>First</b>]]></description></item></channel></rss>'
PDF = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [4 0 R] >>\nendobj\n4 0 obj\n<< /Type /Annot /Subtype /Link /A << /S /URI /URI (https://example.com/from-pdf) >> >>\nendobj\n5 0 obj\n<< /Length 40 >>\nstream\nBT /F1 12 Tf (Hello from a page) Tj ET\nendstream\nendobj\n6 0 obj\n<< /Subject (A \\(short\\) paper) >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 6 0 R >>\n%%EOF"

#: A page whose content is an array of two streams.
PDF_TWO_STREAMS = PDF.replace(b"/Contents 5 0 R", b"/Contents [5 0 R 7 0 R]").replace(b"trailer", b"7 0 obj\n<< /Length 27 >>\nstream\nBT (in two streams) Tj ET\nendstream\nendobj\ntrailer")
PHRASES = [("Running foxes site:example.com the FOREST", "en"), ("site:a.example  site:b.example", "en"), ("the and of", "en"), ("nationally  hopping cats", "xx")]
