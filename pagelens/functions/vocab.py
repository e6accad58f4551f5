"""Vocabularies and weights of the site evidence. All values here are fixed: results depend on them."""

# Path words that name a page's role; the first role in this order wins.
ROLE_WORDS = {
    "about": "about about-us company who-we-are our-story team ueber-uns uber-uns unternehmen a-propos qui-sommes-nous chi-siamo sobre sobre-nosotros nosotros empresa over-ons om-oss hakkimizda onas o-nas".split(),
    "contact": "contact contact-us get-in-touch support help kontakt kontakta contacto contatti contato iletisim impressum".split(),
    "pricing": "pricing price plans packages tariff cost preise preis tarifs prezzi precios precos planes prijzen".split(),
    "products": "product products shop store catalog collections item produkte produkt produits prodotti productos produtos tienda negozio boutique katalog webshop".split(),
    "services": "service services solutions what-we-do offerings dienstleistungen leistungen servizi servicios servicos diensten losungen loesungen".split(),
    "faq": "faq faqs questions knowledge-base haufige-fragen haeufige-fragen preguntas domande".split(),
    "blog": "blog news articles insights press resources post nachrichten aktuelles noticias notizie actualites presse nieuws".split(),
    "legal": "privacy terms legal cookie policy disclaimer gdpr datenschutz agb impressum mentions-legales privacidad privacy-policy aviso-legal".split(),
    "careers": "careers jobs hiring vacancies karriere stellen emplois carriere empleo vagas".split(),
    "account": "login signin sign-in logout signout register signup sign-up account profile dashboard cart basket checkout password auth oauth admin wp-admin search anmelden registrieren warenkorb konto connexion panier carrito carrello iniciar-sesion suche recherche".split(),
}
# Phrases of a title or first-level heading that name a role.
TITLE_PHRASES = {
    "about": ["about", "our story", "who we are", "company"],
    "contact": ["contact", "get in touch"],
    "pricing": ["pricing", "plans", "price"],
    "products": ["product", "shop", "store", "catalog"],
    "services": ["services", "solutions", "what we do"],
    "faq": ["faq", "frequently asked"],
    "blog": ["blog", "news", "article"],
    "legal": ["privacy", "terms", "cookie policy"],
    "careers": ["careers", "jobs"],
}
# Roles that carry public content.
CONTENT_ROLES = ["home", "about", "contact", "pricing", "products", "services", "faq", "blog", "careers"]
# What a role adds to a page's importance; other roles add OTHER_WEIGHT.
ROLE_WEIGHT = {"about": 0.34, "contact": 0.32, "pricing": 0.40, "products": 0.34, "services": 0.34, "faq": 0.26, "blog": 0.10, "careers": 0.06, "legal": 0.0, "account": 0.0, "other": 0.06}
OTHER_WEIGHT = 0.06

# Path words of implementation endpoints.
FRAGMENT_WORDS = "fragment fragments content-fragment content-fragments experience-fragment experience-fragments component components partial partials include includes snippet snippets embed embeds widget widgets module modules block blocks chunk chunks ajax xhr async jcr:content _jcr_content _fragment _partial _next _nuxt __data hybrid-action render".split()
API_WORDS = "api apis graphql gql rest jsonapi wp-json oembed rpc v1 v2 v3 feed rss atom data".split()
UTILITY_WORDS = "search suche recherche buscar filter sort print amp preview ping health healthz status beacon pixel track tracking analytics csrf captcha".split()
# Content types of pages and of structured data.
HTML_TYPES = ["text/html", "application/xhtml"]
STRUCTURED_TYPES = ["application/json", "application/ld+json", "text/json", "application/xml", "text/xml", "application/rss", "application/atom"]

# Severities from least to most, with their weight in a priority and their penalty in a score.
SEVERITIES = ["low", "medium", "high", "critical"]
IMPACT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.25}
PENALTY = {"critical": 45.0, "high": 26.0, "medium": 13.0, "low": 5.0}
# The only checks that may be critical.
MAY_BE_CRITICAL = ["site_unreachable", "robots_blocks_site"]
# Weight of each dimension in the overall score.
DIMENSION_WEIGHT = {"discoverability": 0.25, "content_accessibility": 0.22, "entity_clarity": 0.18, "fact_consistency": 0.12, "freshness": 0.08, "engagement": 0.15}
# Fixed values: (check, base severity, ease of the fix) in the order in which checks report.
CHECKS = [
    ("robots_blocks_site", "critical", 1.0),
    ("homepage_redirects_offsite", "low", 0.9),
    ("redirect_configuration_error", "high", 0.8),
    ("redirect_to_private_address", "high", 0.8),
    ("site_unreachable", "critical", 0.4),
    ("important_page_robots_blocked", "high", 0.9),
    ("ai_crawler_blocked", "high", 1.0),
    ("sitemap_missing", "medium", 0.9),
    ("sitemap_broken_urls", "medium", 0.85),
    ("sitemap_missing_important_pages", "low", 0.9),
    ("important_page_http_error", "high", 0.7),
    ("redirect_chain", "low", 0.8),
    ("noindex_on_important_page", "high", 1.0),
    ("noindex_header_on_important_page", "high", 0.95),
    ("js_dependent_content", "high", 0.35),
    ("important_page_deep", "medium", 0.7),
    ("important_page_orphaned", "medium", 0.75),
    ("thin_important_page", "medium", 0.5),
    ("missing_h1", "low", 0.95),
    ("missing_meta_description", "low", 0.95),
    ("canonical_conflict", "medium", 0.85),
    ("invalid_structured_data", "medium", 0.85),
    ("incomplete_structured_data", "medium", 0.85),
    ("missing_organization_identity", "high", 0.85),
    ("missing_product_structured_data", "medium", 0.7),
    ("facts_in_images", "medium", 0.5),
    ("no_corroborating_entity_links", "low", 0.8),
    ("entity_name_conflict", "high", 0.8),
    ("contact_fact_conflict", "medium", 0.85),
    ("structured_visible_mismatch", "medium", 0.8),
    ("freshness_risk", "low", 0.6),
    ("home_purpose_unclear", "high", 0.6),
    ("page_identity_unclear", "medium", 0.7),
    ("missing_nav_landmark", "low", 0.95),
    ("weak_navigation", "medium", 0.6),
    ("no_next_step", "medium", 0.7),
    ("context_loss_orphan", "medium", 0.7),
]

# Legal forms at the end of a name (two words, then one), words without weight, and hosts of social profiles.
LEGAL_PAIRS = ["pvt ltd", "private limited", "pty ltd"]
LEGAL_WORDS = "llp llc inc ltd limited gmbh bv nv sa srl spa plc corp corporation incorporated sarl ag oy ab kk co".split()
NAME_STOPWORDS = ["the", "a", "an", "and", "of", "for", "&"]
SOCIAL_HOSTS = ["linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "github.com", "crunchbase.com", "wikipedia.org", "wikidata.org", "tiktok.com", "pinterest.com", "threads.net", "mastodon"]

# Words of a call to act.
CALLS = ["buy", "get started", "sign up", "signup", "contact", "book", "request", "demo", "subscribe", "learn more", "start", "try", "order", "quote", "apply", "download", "shop", "call"]
# Agents of AI applications as robots.txt names them.
AI_AGENTS = "gptbot oai-searchbot chatgpt-user claudebot claude-user claude-searchbot anthropic-ai perplexitybot perplexity-user google-extended applebot-extended ccbot bytespider amazonbot meta-externalagent cohere-ai youbot diffbot".split()
# Types of structured data that name an organisation, or a product.
ORGANISATION_TYPES = "organization corporation localbusiness onlinestore store ngo educationalorganization website professionalservice restaurant medicalorganization".split()
PRODUCT_TYPES = "product productgroup offer aggregateoffer".split()
# What a block of structured data of a type must hold.
EXPECTED = {
    "organization": ["name", "url"],
    "corporation": ["name", "url"],
    "localbusiness": ["name"],
    "onlinestore": ["name", "url"],
    "website": ["name", "url"],
    "product": ["name"],
    "article": ["headline", "datePublished"],
    "newsarticle": ["headline", "datePublished"],
    "blogposting": ["headline", "datePublished"],
    "faqpage": ["mainEntity"],
    "breadcrumblist": ["itemListElement"],
}

# Types whose blocks state contacts (besides any type that ends with "business"), and the one that states names only.
CONTACT_TYPES = ["organization", "corporation", "localbusiness", "onlinestore", "store", "ngo", "educationalorganization"]
NAME_TYPES = ["website"]
# Types whose name or headline should agree with the page's heading.
TITLED_TYPES = ["product", "article", "newsarticle", "blogposting"]
# The fields of an address in the order in which they are written.
ADDRESS_FIELDS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
# Fields of structured data, and a property of the page, that hold dates.
DATE_FIELDS = ["datePublished", "dateModified", "uploadDate"]
DATE_PROPERTY = "updated_time"
# Roles whose whole text is searched for contacts.
CONTACT_ROLES = ["contact", "about", "home"]
# Sources of a name that stand by themselves.
STRONG_SOURCES = ["jsonld", "og", "footer"]
