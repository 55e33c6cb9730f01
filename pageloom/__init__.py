"""Documentation-crawl analytics on Spark DataFrames."""

from pageloom.config import CrawlConfig, docs_config, menu_config, plain_config
from pageloom.plans.site import SiteCrawl, crawl_site, write_outputs
from pageloom.session import local_session

__all__ = [
    "CrawlConfig",
    "SiteCrawl",
    "crawl_site",
    "docs_config",
    "local_session",
    "menu_config",
    "plain_config",
    "write_outputs",
]
