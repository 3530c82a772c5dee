"""Canonical table schemas, as DDL text for ``spark.read.schema``."""

from __future__ import annotations

GAZETTES = (
    "id long, territory_id string, territory_name string, state_code string, date date, "
    "scraped_at timestamp_ntz, created_at timestamp_ntz, edition_number string, "
    "is_extra_edition boolean, power string, file_checksum string, file_path string, "
    "file_url string, url string, file_raw_txt string, source_text string, processed boolean"
)

EXCERPTS = (
    "excerpt_id string, excerpt string, excerpt_subthemes array<string>, "
    "excerpt_entities array<string>, excerpt_tfidf_score double, "
    "excerpt_embedding_score double, source_territory_id string, "
    "source_territory_name string, source_state_code string, source_date date, "
    "source_scraped_at timestamp_ntz, source_url string, source_file_raw_txt string, "
    "source_edition_number string, source_is_extra_edition boolean, theme string"
)

THEME_CATALOGUE = (
    "themes array<struct<name string, index string, queries array<struct<title string>>, "
    "entities struct<categories array<struct<name string, description string>>, "
    "cases array<struct<title string, category string>>>>>"
)

CITIES = (
    "city_name string, ibge_id string, uf string, openness_level string, "
    "gazettes_urls string, availability_date string"
)

COMPANY_KEYS = (
    "estabelecimento_cnpj_basico", "estabelecimento_cnpj_ordem", "estabelecimento_cnpj_dv",
)

# Names and order of the published company and partner records.
COMPANY_ATTRIBUTES = (
    "identificador_matriz_filial",
    "nome_fantasia",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "motivo_situacao_cadastral",
    "nome_cidade_exterior",
    "data_inicio_atividade",
    "cnae_fiscal_secundario",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "cep",
    "uf",
    "ddd_telefone_1",
    "ddd_telefone_2",
    "ddd_telefone_fax",
    "correio_eletronico",
    "situacao_especial",
    "data_situacao_especial",
    "razao_social",
    "natureza_juridica",
    "qualificacao_do_responsavel",
    "capital_social",
    "porte",
    "ente_federativo_responsavel",
    "opcao_pelo_simples",
    "data_opcao_pelo_simples",
    "data_exclusao_pelo_simples",
    "opcao_pelo_mei",
    "data_opcao_pelo_mei",
    "data_exclusao_pelo_mei",
    "cnae",
    "pais",
    "municipio",
)
PARTNER_ATTRIBUTES = (
    "identificador_socio",
    "razao_social",
    "cnpj_cpf_socio",
    "qualificacao_socio",
    "data_entrada_sociedade",
    "pais_socio_estrangeiro",
    "numero_cpf_representante_legal",
    "nome_representante_legal",
    "qualificacao_representante_legal",
    "faixa_etaria",
)

COMPANIES = (", ".join(f"{c} string" for c in COMPANY_KEYS + COMPANY_ATTRIBUTES))
PARTNERS = (
    ", ".join(f"{c} string" for c in ("cnpj_basico",) + PARTNER_ATTRIBUTES)
)
SPIDERS = ("spider_name string, date_from date, date_to date, enabled boolean")
JOB_STATS = (
    "id long, spider_name string, job_id string, stats variant, created_at timestamp"
)
