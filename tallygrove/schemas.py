"""Declared tables. Nothing is inferred."""

from __future__ import annotations

LISTING = (
    "id long, source_job_id string, title string, company string, source string, url string, posted_at timestamp, expires_at timestamp, scraped_at timestamp, "
    "city string, state string, country string, is_remote boolean, work_mode string, job_type string, experience_level string, description string, "
    "responsibilities array<string>, qualifications array<string>, benefits array<string>, salary_min double, salary_max double, salary_currency string, "
    "salary_period string, required_skills array<string>, visa_sponsorship boolean, start_date_text string, ai_summary string"
)
#: What a source hands over: as LISTING, without the stored columns, with timestamps still ISO texts.
STAGED = (
    "source_job_id string, title string, company string, source string, url string, posted_at string, expires_at string, city string, state string, country string, "
    "is_remote boolean, work_mode string, job_type string, experience_level string, description string, responsibilities array<string>, qualifications array<string>, "
    "benefits array<string>, salary_min double, salary_max double, salary_currency string, salary_period string, required_skills array<string>, "
    "visa_sponsorship boolean, start_date_text string"
)
CHUNK = "id long, job_id long, chunk_index int, section string, body string, content string, embedding array<double>"
VECTOR = "job_id long, embedding array<double>, content_hash string, n_chunks int, indexed_at timestamp"
RAW = (
    "job_id string, job_title string, employer_name string, job_apply_link string, job_posted_at_datetime_utc string, job_offer_expiration_datetime_utc string, "
    "job_city string, job_state string, job_country string, job_location string, job_is_remote boolean, job_employment_types array<string>, job_description string, "
    "job_min_salary double, job_max_salary double, job_salary_period string, job_salary_currency string, job_salary_string string"
)
LEVER = (
    "id string, text string, hostedUrl string, applyUrl string, createdAt long, workplaceType string, categories struct<commitment:string,location:string>, "
    "descriptionPlain string, additionalPlain string, lists array<struct<text:string,content:string>>"
)
ASHBY = (
    "jobs array<struct<id:string,title:string,jobUrl:string,applyUrl:string,publishedAt:string,location:string,isRemote:boolean,employmentType:string,"
    "descriptionPlain:string,descriptionHtml:string>>"
)
GREENHOUSE = "jobs array<struct<id:string,title:string,company_name:string,absolute_url:string,first_published:string,updated_at:string,location:struct<name:string>,content:string>>"
EVAL_ITEMS = (
    "items array<struct<id:string,answerable:boolean,question:string,job_id:long,chunk_id:long,gold_job_ids:array<long>,company:string,title:string,section:string>>"
)
ANALYSIS = (
    "match_score int, summary string, matched_skills array<string>, missing_skills array<string>, strengths array<string>, improvements array<string>"
)
