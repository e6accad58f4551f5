"""What each finding says to its reader, in this project's own words: title, why it matters, and what to do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stage of a visitor's way at which a check sits. Checks of engagement have none.
STAGES = {
    "discover": "robots_blocks_site homepage_redirects_offsite redirect_configuration_error redirect_to_private_address site_unreachable important_page_robots_blocked ai_crawler_blocked sitemap_missing sitemap_broken_urls sitemap_missing_important_pages important_page_http_error redirect_chain".split(),
    "access": ["noindex_on_important_page", "noindex_header_on_important_page", "important_page_deep", "important_page_orphaned"],
    "understand": ["thin_important_page", "missing_h1", "missing_meta_description", "canonical_conflict"],
    "extract": ["js_dependent_content", "invalid_structured_data", "incomplete_structured_data", "missing_product_structured_data", "facts_in_images", "structured_visible_mismatch"],
    "trust": ["no_corroborating_entity_links", "contact_fact_conflict", "freshness_risk"],
    "represent": ["missing_organization_identity", "entity_name_conflict"],
}
#: check: (title, why it matters, steps). ``{n}`` is the number of pages or values hit.
TEXTS = {
    "robots_blocks_site": ("robots.txt closes the whole site", "No well-behaved reader may open a page.", ["Remove the rule that closes the root.", "Close single paths instead.", "Fetch robots.txt again and test it."]),
    "homepage_redirects_offsite": ("The home page leads to another domain", "What was asked for is not what is judged.", ["Ask for the domain it leads to.", "Check that the redirect is meant."]),
    "redirect_configuration_error": ("The home page's redirects do not end", "Readers give up before they see anything.", ["Trace the chain hop by hop.", "Let each address lead to its end in one hop."]),
    "redirect_to_private_address": ("The home page leads to a private address", "Readers outside the network cannot follow.", ["Correct the address in the redirect.", "Check what the server takes for its own name."]),
    "site_unreachable": ("The home page does not answer", "Nothing of the site can be read.", ["Check name service, certificate and server.", "Try from another network."]),
    "important_page_robots_blocked": ("{n} important pages are closed by robots.txt", "Readers that obey it never see them.", ["Open the paths of these pages.", "Keep private paths closed one by one."]),
    "ai_crawler_blocked": ("robots.txt shuts out agents of AI applications", "Answers will be made without this site.", ["Decide for each agent whether that is meant.", "Open the site to those that should read it."]),
    "sitemap_missing": ("There is no sitemap", "Pages are found by links alone.", ["Write a sitemap of the pages that matter.", "Name it in robots.txt."]),
    "sitemap_broken_urls": ("{n} addresses of the sitemap answer with an error", "Readers learn not to trust the list.", ["Take dead addresses out.", "Make the sitemap from the live site."]),
    "sitemap_missing_important_pages": ("The sitemap leaves out {n} important pages", "They are found later or not at all.", ["Add them.", "Make the sitemap from the live site."]),
    "important_page_http_error": ("{n} pages that matter answer with an error", "What they said is gone for every reader.", ["Bring the pages back or redirect them.", "Mend the links that lead there."]),
    "redirect_chain": ("{n} addresses take several redirects", "Each hop loses time and some readers.", ["Link to the last address.", "Join the redirects into one."]),
    "noindex_on_important_page": ("{n} important pages ask not to be indexed", "Search leaves them out.", ["Remove the request from pages that should be found."]),
    "noindex_header_on_important_page": ("{n} important pages ask in a header not to be indexed", "The page itself shows no trace of it.", ["Find where the header is set.", "Remove it for public pages."]),
    "js_dependent_content": ("{n} pages hold most of their text in scripts", "Readers that run no scripts see little.", ["Send the main text with the page.", "Compare the page with and without scripts."]),
    "important_page_deep": ("{n} important pages are many steps away", "Few readers go that far.", ["Link to them from near the home page."]),
    "important_page_orphaned": ("No page links to {n} important pages", "They are reached only by those who know them.", ["Link to them from pages on the same subject."]),
    "thin_important_page": ("{n} important pages say very little", "There is nothing to answer questions from.", ["Write out what the page is for.", "Check that the text is not in images or scripts."]),
    "missing_h1": ("{n} important pages have no main heading", "The subject has to be guessed.", ["Give each page one heading that names its subject."]),
    "missing_meta_description": ("{n} important pages have no description", "Summaries are made from whatever comes first.", ["Describe each page in one or two sentences."]),
    "canonical_conflict": ("{n} pages name a doubtful address as their own", "Their weight goes to a page that cannot carry it.", ["Let each page name itself or a live page of this site."]),
    "invalid_structured_data": ("{n} pages hold structured data that cannot be read", "The whole block is ignored.", ["Mend the syntax.", "Test blocks before publishing."]),
    "incomplete_structured_data": ("{n} pages hold structured data with gaps", "What is missing cannot be used.", ["Fill in the named fields.", "Replace what a template left open."]),
    "missing_organization_identity": ("No page states whose site this is", "Readers must guess who speaks.", ["State the organisation in structured data on the home page."]),
    "missing_product_structured_data": ("{n} product pages state no product", "Price and name cannot be read reliably.", ["State each product in structured data."]),
    "facts_in_images": ("{n} pages seem to keep their facts in images", "Text in images is not read.", ["Write the facts as text.", "Describe the images."]),
    "no_corroborating_entity_links": ("No profile elsewhere confirms the organisation", "Its word stands alone.", ["List the official profiles with the organisation's data."]),
    "entity_name_conflict": ("The site gives its owner unlike names", "Readers may take them for different owners.", ["Choose one name.", "State others as alternative names."]),
    "contact_fact_conflict": ("Contacts in structured data are not those on the pages", "Readers cannot tell which is right.", ["Make both the same.", "List departments as separate contacts."]),
    "structured_visible_mismatch": ("On {n} pages the stated name is not the heading's", "Readers and machines see different things.", ["Take both from one source."]),
    "freshness_risk": ("The newest dates on {n} pages are years old", "Newer sources are preferred.", ["Check what has changed.", "Show when pages were last revised."]),
    "home_purpose_unclear": ("The home page does not say what is offered", "Visitors leave before they find out.", ["Say it in title, heading and first sentence."]),
    "page_identity_unclear": ("{n} important pages do not say what they are", "Visitors from elsewhere are lost.", ["Give each a telling title and heading."]),
    "missing_nav_landmark": ("{n} pages do not mark their navigation", "Aids and machines cannot tell it apart.", ["Put the links into a nav element."]),
    "weak_navigation": ("Pages hardly link to each other", "Visitors cannot find their way on.", ["Give all pages the same main links."]),
    "no_next_step": ("{n} important pages lead nowhere", "Interest is not followed by anything.", ["Offer the next step on each page."]),
    "context_loss_orphan": ("{n} pages lead to at most one other", "Who arrives there sees nothing else.", ["Link to the pages around them."]),
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def title(check: Column, n: Column) -> Column:
    return F.replace(_map({k: v[0] for k, v in TEXTS.items()})[check], F.lit("{n}"), F.coalesce(n, F.lit(0)).cast("string"))


def impact(check: Column) -> Column:
    return _map({k: v[1] for k, v in TEXTS.items()})[check]


def steps(check: Column) -> Column:
    return F.create_map(*[x for k, v in TEXTS.items() for x in (F.lit(k), F.array(*map(F.lit, v[2])))])[check]


def stage(check: Column) -> Column:
    """The stage, or null."""
    return _map({c: s for s, checks in STAGES.items() for c in checks})[check]
