"""Schemas of the nested records that land as JSON. Fields that a record lacks are null."""

# Field names of the records.
_INSTITUTION = "struct<id:string,display_name:string,country_code:string>"
_NAMED = "struct<display_name:string>"
_TOPIC = f"struct<id:string,display_name:string,count:bigint,subfield:{_NAMED},field:{_NAMED},domain:{_NAMED}>"

AUTHOR = f"""
id string, display_name string, orcid string, works_count bigint, cited_by_count bigint,
summary_stats struct<h_index:bigint,i10_index:bigint>, last_known_institutions array<{_INSTITUTION}>,
affiliations array<struct<institution:{_INSTITUTION}>>, topics array<{_TOPIC}>, x_concepts array<{_NAMED}>,
counts_by_year array<struct<year:int,works_count:bigint,cited_by_count:bigint>>
"""

WORK = f"""
id string, doi string, title string, publication_year int, publication_date string, language string, type string,
indexed_in array<string>, fwci double, has_fulltext boolean, cited_by_count bigint, is_retracted boolean, locations_count int,
locations array<struct<landing_page_url:string>>, referenced_works_count int, ids struct<pmid:string>,
primary_location struct<is_oa:boolean,landing_page_url:string,pdf_url:string,source:struct<id:string,issn_l:string,host_organization_name:string,type:string,display_name:string>>,
open_access struct<is_oa:boolean,oa_status:string>, apc_list struct<value:bigint,currency:string,value_usd:bigint>,
cited_by_percentile_year struct<min:double,max:double>,
authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,is_corresponding:boolean,countries:array<string>,institutions:array<{_INSTITUTION}>>>,
topics array<{_TOPIC}>, keywords array<struct<display_name:string,score:double>>, concepts array<struct<display_name:string,level:int,score:double>>,
mesh array<struct<descriptor_ui:string,descriptor_name:string>>, sustainable_development_goals array<struct<display_name:string,score:double>>,
awards array<struct<id:string,display_name:string,award_id:string,funder_award_id:string,funder:string,funder_id:string,funder_display_name:string,funder_ror:string>>,
counts_by_year array<struct<year:int,cited_by_count:bigint>>, abstract_inverted_index map<string,array<int>>
"""

_DATE = "struct<date:string>"
STUDY = f"""
protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,
statusModule:struct<overallStatus:string,startDateStruct:{_DATE},primaryCompletionDateStruct:{_DATE},completionDateStruct:{_DATE}>,
designModule:struct<phases:array<string>>,conditionsModule:struct<conditions:array<string>>,
armsInterventionsModule:struct<interventions:array<struct<name:string>>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,
contactsLocationsModule:struct<overallOfficials:array<struct<name:string,role:string,officialRole:string>>>>
"""
AWARD_LIST = "array<struct<id:string,display_name:string,award_id:string,funder_award_id:string,funder:string,funder_id:string,funder_display_name:string,funder_ror:string>>"
