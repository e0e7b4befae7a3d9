"""Languages of the speech corpus, their codes in the sentence corpus and in models, and the languages of the other sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Speech code and sentence code of each language.
CODES = """
af_za afr_Latn, am_et amh_Ethi, ar_eg arb_Arab, as_in asm_Beng, ast_es ast_Latn, az_az azj_Latn, be_by bel_Cyrl,
bg_bg bul_Cyrl, bn_in ben_Beng, bs_ba bos_Latn, ca_es cat_Latn, ceb_ph ceb_Latn, ckb_iq ckb_Arab, cmn_hans_cn zho_Hans,
cs_cz ces_Latn, cy_gb cym_Latn, da_dk dan_Latn, de_de deu_Latn, el_gr ell_Grek, en_us eng_Latn, es_419 spa_Latn,
et_ee est_Latn, fa_ir pes_Arab, fi_fi fin_Latn, fil_ph tgl_Latn, fr_fr fra_Latn, ga_ie gle_Latn, gl_es glg_Latn,
gu_in guj_Gujr, ha_ng hau_Latn, he_il heb_Hebr, hi_in hin_Deva, hr_hr hrv_Latn, hu_hu hun_Latn, hy_am hye_Armn,
id_id ind_Latn, ig_ng ibo_Latn, is_is isl_Latn, it_it ita_Latn, ja_jp jpn_Jpan, jv_id jav_Latn, ka_ge kat_Geor,
kam_ke kam_Latn, kea_cv kea_Latn, kk_kz kaz_Cyrl, km_kh khm_Khmr, kn_in kan_Knda, ko_kr kor_Hang, ky_kg kir_Cyrl,
lb_lu ltz_Latn, lg_ug lug_Latn, ln_cd lin_Latn, lo_la lao_Laoo, lt_lt lit_Latn, luo_ke luo_Latn, lv_lv lvs_Latn,
mi_nz mri_Latn, mk_mk mkd_Cyrl, ml_in mal_Mlym, mn_mn khk_Cyrl, mr_in mar_Deva, ms_my zsm_Latn, mt_mt mlt_Latn,
my_mm mya_Mymr, nb_no nob_Latn, ne_np npi_Deva, nl_nl nld_Latn, nso_za nso_Latn, ny_mw nya_Latn, oc_fr oci_Latn,
or_in ory_Orya, pa_in pan_Guru, pl_pl pol_Latn, ps_af pbt_Arab, pt_br por_Latn, ro_ro ron_Latn, ru_ru rus_Cyrl,
sd_in snd_Arab, sk_sk slk_Latn, sl_si slv_Latn, sn_zw sna_Latn, so_so som_Latn, sr_rs srp_Cyrl, sv_se swe_Latn,
sw_ke swh_Latn, ta_in tam_Taml, te_in tel_Telu, tg_tj tgk_Cyrl, th_th tha_Thai, tr_tr tur_Latn, uk_ua ukr_Cyrl,
umb_ao umb_Latn, ur_pk urd_Arab, uz_uz uzn_Latn, vi_vn vie_Latn, wo_sn wol_Latn, xh_za xho_Latn, yo_ng yor_Latn,
yue_hant_hk zho_Hant, zu_za zul_Latn, ff_sn fuv_Latn, om_et gaz_Latn
"""
# Sentence codes of the comprehension set.
PASSAGES = """
acm_Arab afr_Latn als_Latn amh_Ethi apc_Arab arb_Arab arb_Latn ars_Arab ary_arab arz_Arab asm_Beng azj_Latn bam_Latn
ben_Beng ben_Latn bod_Tibt bul_Cyrl cat_Latn ceb_Latn ces_Latn ckb_Arab dan_Latn deu_Latn ell_Grek eng_Latn est_Latn
eus_Latn fin_Latn fra_Latn fuv_Latn gaz_Latn grn_Latn guj_Gujr hat_Latn hau_Latn heb_Hebr hin_Deva hin_Latn hrv_Latn
hun_Latn hye_Armn ibo_Latn ilo_Latn ind_Latn isl_Latn ita_Latn jav_Latn jpn_Jpan kac_Latn kan_Knda kat_Geor kaz_Cyrl
kea_Latn khk_Cyrl khm_Khmr kin_Latn kir_Cyrl kor_Hang lao_Laoo lin_Latn lit_Latn lug_Latn luo_Latn lvs_Latn mal_Mlym
mar_Deva mkd_Cyrl mlt_Latn mri_Latn mya_Mymr nld_Latn nob_Latn npi_Deva npi_Latn nso_Latn nya_Latn ory_Orya pan_Guru
pbt_Arab pes_Arab plt_Latn pol_Latn por_Latn ron_Latn rus_Cyrl shn_Mymr sin_Latn sin_Sinh slk_Latn slv_Latn sna_Latn
snd_Arab som_Latn sot_Latn spa_Latn srp_Cyrl ssw_Latn sun_Latn swe_Latn swh_Latn tam_Taml tel_Telu tgk_Cyrl tgl_Latn
tha_Thai tir_Ethi tsn_Latn tso_Latn tur_Latn ukr_Cyrl urd_Arab urd_Latn uzn_Latn vie_Latn war_Latn wol_Latn xho_Latn
yor_Latn zho_Hans zho_Hant zsm_Latn zul_Latn
"""
# Codes of models that differ from the rule in model_code().
WHISPER = """
ast_es es, ceb_ph tl, ckb_iq ar, cmn_hans_cn zh, ff_sn fr, fil_ph tl, ga_ie cy, ig_ng yo, jv_id jw, kam_ke sw, kea_cv pt,
ky_kg kk, lg_ug sw, luo_ke sw, nb_no no, nso_za sw, ny_mw sw, om_et so, or_in bn, umb_ao pt, wo_sn fr, xh_za sw, zu_za sw
"""
MMS = """
ar_eg ara, az_az azj-script_latin, cmn_hans_cn cmn-script_simplified, ff_sn ful, fil_ph fil, ka_ge kat-script_georgian,
lv_lv lav, mn_mn mon, ms_my msa-script_latin, ne_np nep, om_et orm, ps_af pus, sr_rs srp-script_cyrillic, sw_ke swa,
ur_pk urd-script_arabic, uz_uz uzb-script_latin, yue_hant_hk yue
"""
SEAMLESS = """
ar_eg arz, ast_es spa, cmn_hans_cn cmn, ha_ng fuv, kam_ke swh, kea_cv por, lb_lu deu, ln_cd lug, mi_nz jav, ms_my zlm,
nso_za zul, oc_fr cat, umb_ao swh, wo_sn fuv, xh_za zul, yue_hant_hk yue
"""
# Names of download folders that differ from the speech code.
RENAMED = {"rup_bg": "bg_bg", "ku_arab_iq": "ckb_iq", "oci_fr": "oc_fr", "sd_arab_in": "sd_in"}


def pairs(table: str) -> dict[str, str]:
    return dict(pair.split() for pair in table.split(","))


def model_code(model: str, language: str) -> str:
    """The code by which a model knows a language of the speech corpus; an unknown language or model raises.

    By rule: the part before the first underscore for whisper, the first three letters of the sentence code for the others.
    """
    sentence = pairs(CODES).get(language)
    if sentence is None:
        raise ValueError(f"no such language in the speech corpus: {language}")
    if model == "whisper":
        return pairs(WHISPER).get(language, language.split("_")[0])
    if model in ("mms", "seamlessm4t"):
        return pairs(MMS if model == "mms" else SEAMLESS).get(language, sentence[:3])
    raise ValueError(f"no codes for model {model}")


def languages(spark: SparkSession) -> DataFrame:
    """fleurs_code, flores_code, whisper_code, mms_code, seamless_code, in_belebele, in_sib (all): 102 rows."""
    known = set(PASSAGES.split())
    rows = [(a, b, *(model_code(m, a) for m in ("whisper", "mms", "seamlessm4t")), b in known, True) for a, b in pairs(CODES).items()]
    return spark.createDataFrame(rows, "fleurs_code string, flores_code string, whisper_code string, mms_code string, seamless_code string, in_belebele boolean, in_sib boolean")


def with_passages(frame: DataFrame, key: str = "lang") -> DataFrame:
    """Rows of languages that the comprehension set has."""
    return frame.where(frame[key].isin(PASSAGES.split()))


def with_topics(frame: DataFrame, topics: DataFrame, key: str = "lang") -> DataFrame:
    """Rows of languages that the topic set has: those with items in topics(lang, ...), in any of its splits. The set has some
    two hundred languages, all of the speech corpus among them; which, its own table says."""
    return frame.join(topics.select(F.col("lang").alias(key)).distinct(), key, "left_semi").select(*frame.columns)


def speech_code(folder: str) -> str:
    """The speech code of a download folder."""
    return RENAMED.get(folder, folder)
